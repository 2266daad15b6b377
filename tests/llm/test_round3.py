"""Source divergence, toxicity and code compression against brute force, and their defined cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evidence_engine.llm import code_compression, divergence, toxicity
from tests.llm.test_operators import LONG, empty_docs, odd_docs, sample_docs

# Source divergence


def brute_divergence(rows, least=3, top=200):
    """rows: lang, source, text. All shares of all kept terms, absent ones included."""
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(a or "", b or "", term.findall((t or "").translate(lower))) for a, b, t in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        groups = {s: [counts[lang, s][t] for t in kept] for _, s in {(a, b) for a, b, _ in docs if a == lang}}
        share = lambda c: [1 + 10**9 * (x + 1) // (sum(c) + len(kept)) for x in c]
        p = {s: share(c) for s, c in groups.items()}
        q = share([sum(x) for x in zip(*groups.values(), strict=True)]) if kept else []
        for s in groups:
            pairs = [(-sum((a - b) * (a - b) // b for a, b in zip(p[s], p[t], strict=True)), t.encode()) for t in groups if t != s]
            terms = [(-((a - b) ** 2 // b), t.encode()) for t, c, a, b in zip(kept, groups[s], p[s], q, strict=True) if c and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(found, 1)]
    return sorted(out)


def audited(spark, docs, **options):
    rows = divergence.divergence(spark, docs, **options).select("lang", "source", "part", "item", "value", "rank").collect()
    return sorted(map(tuple, rows))


def test_divergence(spark, sf):
    docs = sample_docs(spark, sf)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert audited(spark, docs, block_bytes=20_000, top=7) == brute_divergence(rows, top=7)


def test_divergence_of_few_sources_at_a_time(spark, sf, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES_EACH", 6)
    docs = sample_docs(spark, sf)
    assert audited(spark, docs, block_bytes=1 << 20) == brute_divergence([(r.lang, r.source, r.text) for r in docs.collect()])


def test_divergence_cases(spark):
    assert audited(spark, empty_docs(spark).selectExpr("*", "id as lang", "id as source")) == []
    rows = [(1, None, None, None), (2, "", "a", ""), (3, "x", None, "A b"), (3, "x", None, "A b"), (4, "x", "s", "a B!c"), (5, "x", "s", "Ünï À　x\x85y 12"), (6, "y", "s", "one"),
            (7, "y", "t", None), (None, "x", "t", "a a b"), (8, "x", "u", LONG), (9, "x", "u", LONG), (10, "x", "v", LONG + " İ ſ K")]
    docs = spark.createDataFrame([(*r, "z", 7) for r in rows], "doc_id long, lang string, source string, text string, term string, block int").repartition(3)
    assert audited(spark, docs) == brute_divergence([r[1:] for r in rows])
    odd = odd_docs(spark).selectExpr("*", "'l' as lang", "path as source")
    assert audited(spark, odd, least=2) == brute_divergence([("l", r.path, r.text) for r in odd.collect()], least=2)


@pytest.mark.parametrize("count,total", [(0, 1), (0, 3), (10**12, 9 * 10**15), (9 * 10**15 - 1, 9 * 10**15), (123_456_789_012, 987_654_321_098_765)])
def test_shares_are_exact(spark, count, total):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(count, total)], "c long, t long").select(divergence._share(F.col("c"), F.col("t"))).first()[0]
    assert got == 1 + 10**9 * (count + 1) // total


# Toxicity


def auc(score, toxic):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = toxic.sum()
    return (rank[toxic].sum() - n * (n - 1) / 2) / (n * (len(score) - n))


def test_held_out_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = toxicity.op12_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in marks]
    toxic, hit = np.array([marks[r.doc_id] == 1 for r in held]), np.array([r.predicted == 1 for r in held])
    # About one label in thirteen marks text without any sign of it.
    assert auc(np.array([r.score for r in held]), toxic) > 0.94
    assert (toxic & hit).sum() / hit.sum() > 0.97 and (toxic & hit).sum() / toxic.sum() > 0.85


def test_risk_keeps_unlabelled_toxic_text_toxic():
    """Of the unlabelled rows three in ten are toxic; they are told from the clean ones though all count as unlabelled."""
    rs = np.random.RandomState(1)
    toxic = np.abs(rs.randn(3300, 20)) * (rs.rand(3300, 20) < 0.4)
    clean = np.abs(rs.randn(7000, 20)) * (rs.rand(7000, 20) < 0.05)
    w, b, turned = toxicity.learn(toxic[:300], np.r_[toxic[300:], clean], 0.3, 0)
    hidden, others = toxic[300:] @ w + b, clean @ w + b
    assert auc(np.r_[hidden, others], np.r_[np.ones(3000, bool), np.zeros(7000, bool)]) > 0.98
    assert (hidden > 0).mean() > 0.75 and (others > 0).mean() < 0.05 and turned
    # With nothing corrected for, one in thirty rows being known as toxic, few are called toxic.
    w, b, _ = toxicity.learn(toxic[:300], np.r_[toxic[300:], clean], 0.03, 0)
    assert ((toxic[300:] @ w + b) > 0).mean() < 0.3


def test_features():
    assert toxicity.features_of("clowns") == ["=clowns", "^clo", "^clow", "^clown"]
    assert {"你好", "好吗", "你好吗"} <= set(toxicity.features_of("你好吗"))
    assert toxicity.words_of(b"IDIOT!!idiot 12 \xff_x") == {"idiot": 2, "x": 1}


def test_toxicity_cases(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(spark, docs, none)).collect()} == {0.0}
    rows = [(i, f"plain words number{i % 7} and more of it" + (" you moron idiot" if i % 4 == 0 else "")) for i in range(400)]
    texts = spark.createDataFrame([*rows, (None, "moron"), (7, None), (7, ""), (8, "a moron idiot " * 50_000)], "doc_id long, text string").repartition(3)
    marks = [(i, int(i % 4 == 0)) for i in range(0, 400, 2)] + [(None, 1), (5000, 1), (3, None), (0, 0), (0, 1)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, toxic int, text string")
    model = toxicity.train(spark, texts, labels)
    got = toxicity.score(texts.withColumn("score", texts.text), model).collect()
    assert len(got) == 404
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.score)
    assert all((max(by[i]) > 0.5) == (i % 4 == 0) for i, _ in rows if i not in (7, 8)) and max(by[8]) > 0.5 and by[None][0] > 0.5 and max(by[7]) < 0.5
    assert toxicity.score(empty_docs(spark), model).count() == 0
    assert toxicity.train(spark, empty_docs(spark), none) is None


# Code compression


def brute_compression(rows, parts=4, entries=256, rounds=4):
    """rows: vec_id, vector (whole numbers), label; distances of all pairs in Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    if not rows:
        return []
    dim = len(rows[0][1])
    cut = [(k * dim // parts, (k + 1) * dim // parts) for k in range(parts)]
    books = [[r[1][a:b] for r in rows[:entries]] for a, b in cut]

    def near(book, x):
        return min((sum((p - q) ** 2 for p, q in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for k, (a, b) in enumerate(cut):
            members = defaultdict(list)
            for r in rows:
                members[near(books[k], r[1][a:b])[1]].append(r[1][a:b])
            books[k] = [[sum(c) // len(c) for c in zip(*members[e], strict=True)] if e in members else c for e, c in enumerate(books[k])]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    found = [(r[0], [near(books[k], r[1][a:b]) for k, (a, b) in enumerate(cut)], r[2]) for r in rows]
    by = Counter()
    for _, ds, label in found:
        by[label] += min(2**63 - 1, sum(d for d, _ in ds))
    cap = lambda x: min(2**63 - 1, x)
    return sorted(((i, "".join(f"{e:02x}" for _, e in ds), cap(sum(d for d, _ in ds)), cap(by[label]), digest) for i, ds, label in found), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)


def compressed(spark, rows):
    return sorted(map(tuple, code_compression.compress(spark, vectors(spark, rows)).collect()), key=repr)


def whole_rows(rows):
    import math

    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    exact = lambda x: int(x) * 1024 if abs(x) > 2**53 else math.floor(1024 * x)
    return [(i, [exact(x) for x in v], lab) for i, v, lab in rows if good(v)]


@pytest.mark.parametrize("seed,n,dim,scale", [(0, 700, 8, 1.0), (1, 300, 16, 0.004), (2, 90, 6, 3.0), (3, 40, 8, 1e9), (4, 30, 4, 1e35)])
def test_compression(spark, seed, n, dim, scale):
    rs = np.random.RandomState(seed)
    rows = [(int(i), (rs.randn(dim) * scale).tolist(), int(rs.randint(3)) if i % 5 else None) for i in rs.permutation(n) - n // 2]
    assert compressed(spark, rows) == brute_compression(whole_rows(rows))


def test_compression_cases(spark):
    assert compressed(spark, []) == []
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [nan] * 4, 1), (3, [inf, 0.0, 0.0, 0.0], 1), (4, [None, 0.0, 0.0, 0.0], 1)]
    assert compressed(spark, rows) == []
    rows += [(5, [0.5, -0.5, 0.25, -0.0001], None), (6, [0.5, -0.5, 0.25, 0.0], 2), (6, [0.5, -0.5, 0.25, 0.0], 2), (None, [1.0, 1.0, 1.0, 1.0], 2), (7, [1.0, 2.0], 2), (8, [], None), (9, [2e38, 0.0, 1.0, 1.0], 1)]
    assert compressed(spark, rows) == brute_compression(whole_rows(rows))
    assert compressed(spark, [(1, [], 1), (2, [], None)]) == brute_compression([(1, [], 1), (2, [], None)])


@pytest.mark.parametrize("seed", range(6))
def test_tree_is_exact_and_prunes(seed):
    rs = np.random.RandomState(seed)
    spread = [3, 30, 300][seed % 3]
    centres = rs.randint(-2000, 2000, (20, 4))
    book = (centres[rs.randint(0, 20, 256)] + rs.randint(-spread, spread, (256, 4))).astype(float)
    book[rs.randint(0, 256, 40)] = book[:40]  # ties
    x = (centres[rs.randint(0, 20, 3000)] + rs.randint(-spread, spread, (3000, 4))).astype(float)
    x[:256] = book
    d2 = code_compression.squared(x, book)
    entry, best, met = code_compression.nearest(book, code_compression.grow(book), x)
    assert (entry == d2.argmin(1)).all() and (best == d2.min(1)).all()
    assert met < d2.size / 2


def test_divergence_sends_back_only_what_is_not_kept(spark, monkeypatch):
    """Blocks get the few terms that are not kept, and results are those of brute force for any least number."""
    rows = [(i, f"common words here {'twice' if i in (3, 17) else ''} w{chr(97 + i % 7) * 3} u{chr(97 + i % 26) * 2}{chr(97 + i // 26)}", "l", f"s{i % 3}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    for least in (1, 2, 3, 4, 6):
        assert audited(spark, docs, least=least, block_bytes=200) == brute_divergence([(r[2], r[3], r[1]) for r in rows], least=least)


@pytest.mark.parametrize("n", [50, 1_000_000])
def test_divergence_counts_occurrences_without_sorting_them(n, monkeypatch):
    at = np.array([3, 1, 3, 49, 3] * 10)
    if n == 50:
        monkeypatch.setattr(np, "unique", None)
    found, count = divergence._counted(at, n)
    assert found.tolist() == [1, 3, 49]
    assert count.tolist() == [10, 30, 10]
