"""Language identification, decontamination and the pipeline."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from evidence_engine.llm import decontaminate, language_id, packing
from tests.llm.test_operators import ODD, check_packed, empty_docs, odd_docs, sample_docs

# Language identification


def plain_posteriors(scores, transitions, start):
    n, k = scores.shape
    f, b = np.zeros((n, k)), np.zeros((n, k))
    total = lambda x, ax: np.log(np.exp(x).sum(axis=ax))
    f[0] = start + scores[0]
    for t in range(1, n):
        f[t] = scores[t] + total(f[t - 1][:, None] + transitions, 0)
    for t in range(n - 2, -1, -1):
        b[t] = total(transitions + (scores[t + 1] + b[t + 1])[None], 1)
    return np.exp(f + b - total(f[-1], 0))


@pytest.mark.parametrize("n,restarts", [(1, [0]), (48, [0]), (49, [0, 48]), (300, [0, 1, 47, 48, 200])])
def test_forward_backward_is_exact(n, restarts):
    rs = np.random.RandomState(n)
    scores, transitions, start = rs.randn(n, 4) * 3, rs.randn(4, 4), rs.randn(4)
    restart = np.zeros(n, bool)
    restart[restarts] = True
    want = np.concatenate([plain_posteriors(scores[a:b], transitions, start) for a, b in zip(restarts, [*restarts[1:], n], strict=True)])
    assert np.allclose(language_id.posteriors(scores, restart, transitions, start), want)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language_id.op1_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_code_switching_is_labelled_word_by_word(spark):
    docs = sample_docs(spark, "/root/testdata/sf0.01")
    model = language_id.train(language_id.training_sample(docs))
    by = {}
    for r in docs.collect():
        by.setdefault(r.lang, []).append(" ".join(r.text.split()[:40]))
    words = language_id.words_of([by["fr"][0] + " " + by["de"][0]])
    p = language_id.posteriors(language_id._emit(words, model.emissions), np.r_[True, np.zeros(len(words.first) - 1, bool)], model.transitions, model.start)
    n = len(language_id.words_of([by["fr"][0]]).first)
    got = np.array(model.labels)[p.argmax(axis=1)]
    assert (got[:n] == "fr").mean() > 0.9 and (got[n:] == "de").mean() > 0.9


def test_language_cases(spark):
    docs = sample_docs(spark, "/root/testdata/sf0.01")
    model = language_id.train(language_id.training_sample(docs))
    got = {(r.doc_id, r.lang_pred == "und") for r in language_id.identify(odd_docs(spark), model).collect()}
    assert got == {(i, not any(c.isalpha() for c in t or "")) for i, t in ODD}
    assert {r.lang_pred for r in language_id.identify(odd_docs(spark), None).collect()} == {"und"}
    assert language_id.identify(empty_docs(spark), model).collect() == []
    none = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert language_id.training_sample(none) == [] and language_id.train([]) is None


# Decontamination

ITEMS = [(1, "If Alice drives 120 km in 3 hours from Paris to the coast, how fast does Alice drive on average today?"), (2, "the quick brown fox jumps over the lazy dog again"), (3, None), (4, ""), (5, "12 13 14 15 16 17 18 19 20 21 22 23 24 25")]
TEXTS = [
    (1, "Intro. " + ITEMS[0][1] + " Outro."),
    (2, "x If Bob drives 90 miles in 2 hours from London to the coast, how fast does Bob drive on average today? y"),
    (3, "If Bob drives 90 miles in 2 hours from London to the coast, how fast does Carol drive on average today?"),
    (4, "so the quick brown fox jumps over the lazy dog again!"),
    (5, "the quick brown fox jumps over the lazy cat"),
    (6, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"),
    (7, None),
    (8, ""),
    (9, "nothing of the kind stands in here at all, not even once or twice or at length"),
]


def test_templates_and_slots(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in TEXTS], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id, r.verbatim) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1, True), (2, 1, False), (4, 2, True)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {3, 5, 6, 7, 8, 9}
    assert decontaminate.contaminated(docs, items.limit(0)).collect() == []
    assert decontaminate.contaminated(empty_docs(spark), items).collect() == []


def test_verbatim_copies_without_literals(spark):
    items = [(1, "Who Wrote The Book Of Songs That Every Child In North Wales Knows By Heart?"), (2, "12 + 30 = 42; 7 * 6 = 42; 81 - 39 = 42; 84 / 2 = 42; 40 + 2 = 42"), (3, "Name: Ada Lovelace"), (4, "one two three")]
    texts = [(1, f"so {items[0][1]} yes"), (2, f"x {items[1][1]} y"), (3, "name: ada lovelace."), (4, "Who Wrote The Song Of Books That Every Child In South Wales Knows By Heart?"), (5, "one two four three")]
    texts.append((6, "see 30 = 42; 7 * 6 = 42; 81 - 39 = 42; 84 / 2 = 42; 40 + 2 there"))  # 13 tokens of item 2
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.verbatim) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, True), (6, 2, True)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {4, 5}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items.limit(0)).collect()} == {1, 2, 3, 4, 5, 6}


def test_contaminated_rows_go_by_their_texts(spark):
    """Rows without an id, rows of one id, and columns that the operator uses itself."""
    bad = TEXTS[1][1]
    rows = [(None, bad, 1, "a"), (1, bad, 2, "b"), (1, "a clean text", 3, "c"), (None, None, 4, "d"), (2, "", 5, "e"), (2, bad, 6, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key0 int, hashes string")
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert left.columns == docs.columns and sorted(r.key0 for r in left.collect()) == [3, 4, 5]


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_against_brute_force(spark, seed):
    """Questions with other numbers and names, cut at either end, amid other words; every pair is judged without an index."""
    rng = random.Random(seed)
    words = ["w" + "".join(chr(97 + int(c)) for c in str(k)) for k in range(400)]
    slot = lambda: rng.choice(["Alice", "Bob", "Carol", "12", "7", "km", "miles", "30"])
    items = [(i, [slot() if rng.random() < 0.25 else rng.choice(words) for _ in range(rng.randint(3, 40))]) for i in range(40)]
    docs = []
    for d in range(120):
        _, source = rng.choice(items)
        swap = {x: slot() for x in ("Alice", "Bob", "Carol", "12", "7", "km", "miles", "30")}
        a = rng.randint(0, max(0, len(source) - 10))
        part = [swap.get(w, w) if d % 3 else w for w in source[a : a + rng.randint(8, 40)]]
        if d % 5 == 0 and part:
            part[rng.randrange(len(part))] = rng.choice(words)
        docs.append((d, [rng.choice(words) for _ in range(6)] + part + [rng.choice(words) for _ in range(6)]))

    def kind(w):
        return "n" if w.isdigit() else "u" if w in decontaminate.UNITS else "N" if w[0].isupper() else w

    def brute(doc, item):
        """Whether some diagonal contaminates: runs of equal templates that hold an eligible window, then the slots."""
        n, need = len(item), min(13, len(item))
        size = min(8, n)
        for diagonal in range(1 - n, len(doc)):
            agree = [q for q in range(n) if 0 <= q + diagonal < len(doc) and kind(item[q]) == kind(doc[q + diagonal])]
            runs, run = [], []
            for q in agree:
                if run and q != run[-1] + 1:
                    runs.append(run)
                    run = []
                run.append(q)
            runs.append(run)
            literal = lambda q: kind(item[q]) == item[q]
            runs = [r for r in runs if any(sum(map(literal, r[k : k + size])) >= 4 and len(r[k : k + size]) == size for k in range(len(r)))]
            pairs = [[(kind(item[q]), item[q].lower(), doc[q + diagonal].lower()) for q in r] for r in runs]

            def steady(found):
                seen = {}
                return all(seen.setdefault((k, v), o) == o for k, v, o in found if k in ("n", "u", "N"))

            if sum(map(len, runs)) >= need:
                if steady(sum(pairs, [])) or any(len(r) >= 13 and steady(r) for r in pairs):
                    return True
            own = [q for q in range(n) if 0 <= q + diagonal < len(doc) and item[q].lower() == doc[q + diagonal].lower()]
            best = here = 0
            last = -9
            for q in own:
                here = here + 1 if q == last + 1 else 1
                best, last = max(best, here), q
            if best >= need:
                return True
        return False

    want = {(d, i) for d, doc in docs for i, item in items if brute(doc, item)}
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{key} long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == want and len(want) > 30


def test_windows_in_pieces(spark, monkeypatch):
    """A passage that lies across the cut of a long text is found."""
    import evidence_engine.llm.common as common

    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    texts = [(k, "pad " * k + item + " pad" * 40) for k in range(60)]
    monkeypatch.setattr(common.cut_at_space, "__defaults__", (64,))
    tokens = decontaminate.Tokens()
    own = decontaminate.Item(1, item.encode(), tokens)
    wanted = decontaminate._Filter(np.concatenate([own.hashes, own.raw_hashes]), [16, 27])
    whole = set(own.hashes.tolist()) | set(own.raw_hashes.tolist())
    for _, t in texts:
        assert set(wanted.hits(t.encode(), tokens).tolist()) == whole


def test_every_block_of_a_benchmark_counts(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = {tuple(r) for r in decontaminate.contaminated(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 20)
    assert {tuple(r) for r in decontaminate.contaminated(docs, items).collect()} == whole


def test_shared_passages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text.split() for r in sample_docs(spark, sf).collect()}
    items = {r.item_id: r.text.split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    runs = {tuple(w[k : k + 13]): i for i, w in items.items() for k in range(len(w) - 12)}
    want = {(d, runs[t]) for d, w in docs.items() for k in range(len(w) - 12) if (t := tuple(w[k : k + 13])) in runs}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op6_decontaminate(spark, sf).collect()}
    assert want <= got and len(got - want) <= 0.05 * len(got) + 1


# Pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    docs = sample_docs(spark, "/root/testdata/sf0.001")
    langs = docs.collect()
    rows = [tuple(r) for r in langs] + [(9001, None, None, None, None), (9002, "123 456 !!", "en", "s", 9), (9003, "", "en", "s", 0)]
    rows.append((9004, langs[5].text, "en", "s", 1))
    text = " ".join(rng.choice(langs[7].text.split()) for _ in range(60))
    rows.append((9005, text + " password=hunter2hunter2", "fr", "s", 3))
    path = str(tmp_path)
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    left, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, path)
        assert left.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in left.collect()}
    ids = {r[0] for r in rows}
    assert ids - set(kept["language_id"]) == {9001, 9002, 9003}
    assert 9004 not in kept["near_dedup"] and langs[5].doc_id in kept["near_dedup"]
    dirty = {r.doc_id for r in decontaminate.contaminated(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")).collect()}
    assert set(kept["near_dedup"]) - set(kept["decontaminate"]) == dirty & set(kept["near_dedup"])
    assert kept["secret_scan"][9005] == text + " [assign]" and set(kept["secret_scan"]) == set(kept["decontaminate"])
    from tokenizers import Tokenizer

    check_packed(corpus_pipeline.run(spark, path).collect(), list(kept["secret_scan"].items()), Tokenizer.from_file(packing.default_vocabulary()))


def test_pipeline_on_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []
