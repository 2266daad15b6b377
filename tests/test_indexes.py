"""The stored indexes against searches over everything: rankings, upkeep, and how little is read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_engine.operators import lexical, postings, vector, vector_index
from evidence_engine.sources.tables import chunks, query_set

_CHUNKS = "chunk_id long, content string, token_count long"


def corpus(rng, ids, words=40):
    # Words fall off in frequency, so some are nearly everywhere.
    return [(c, " ".join(f"w{int(words * rng.random() ** 3)}" for _ in range(rng.randint(1, 60)))) for c in ids]


def frame(spark, rows):
    return spark.createDataFrame([(c, t, len(t)) for c, t in rows], _CHUNKS)


def asked_of(spark, rng, n=12, words=45):
    return spark.createDataFrame([(q, " ".join(f"w{rng.randrange(words)}" for _ in range(rng.randint(1, 9)))) for q in range(n)], "query_id long, text string")


def both(asked, rows, at, k=5):
    got, want = postings.search(asked, at, k, bounded=True).collect(), lexical.bm25(asked, rows, k).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) == sorted(map(tuple, postings.search(asked, at, k, bounded=False).collect()))
    return got


@pytest.mark.parametrize("seed", range(2))
def test_blocks_give_the_same_ranking(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(postings, "BLOCK", 8)
    monkeypatch.setattr(postings, "FIRST", 30)
    rng = random.Random(seed)
    rows = frame(spark, corpus(rng, range(400)))
    at = f"file://{tmp_path}/index"
    postings.append(rows, at, buckets=4)
    assert both(asked_of(spark, rng), rows, at)


def test_upkeep_equals_a_new_index(spark, tmp_path):
    """Appends, replaced chunks, deletions of stored and unknown ids, a chunk that comes back, and compaction."""
    rng = random.Random(5)
    at, live = f"file://{tmp_path}/index", {}

    def put(ids):
        rows = corpus(rng, ids)
        live.update(rows)
        postings.append(frame(spark, rows), at, buckets=2)

    def drop(ids):
        for i in ids:
            live.pop(i, None)
        postings.delete(spark.createDataFrame([(i,) for i in ids], "chunk_id long"), at)

    asked = asked_of(spark, rng)
    put(range(120))
    put(range(100, 160))
    drop([*range(0, 120, 3), 999])
    put(range(0, 30, 2))
    both(asked, frame(spark, list(live.items())), at)
    s = postings.state(spark, at)
    assert (s.n, s.total, len(s.segments)) == (len(live), sum(map(len, live.values())), 4)
    postings.compact(spark, at)
    drop(range(1, 160, 7))
    both(asked, frame(spark, list(live.items())), at)
    assert len(postings.state(spark, at).segments) == 2
    drop(range(160))
    assert postings.search(asked, at, 5).collect() == [] and postings.state(spark, at).n == 0


def test_index_of_awkward_chunks(spark, tmp_path):
    rows = [(1, "a b a"), (2, "b"), (3, ""), (4, "!!"), (5, "a " * 3000), (6, "词语词语")]
    at = f"file://{tmp_path}/index"
    postings.append(frame(spark, rows), at, buckets=3)
    asked = spark.createDataFrame([(1, "a b 词语"), (2, ""), (3, None), (4, "nowhere"), (5, "a a a")], "query_id long, text string")
    both(asked, frame(spark, rows), at)
    empty = f"file://{tmp_path}/empty"
    postings.append(frame(spark, []), empty, buckets=2)
    assert postings.search(asked, empty).collect() == []


def test_frequent_terms_are_read_in_part(spark, tmp_path):
    """Of the blocks of terms that a tenth of the chunks hold, each query reads fewer than a half."""
    sf = "/root/testdata/sf0.01"
    at, rows, asked = f"file://{tmp_path}/index", chunks(spark, sf), query_set(spark, sf)
    postings.append(rows, at, buckets=4)
    s = postings.state(spark, at)
    weighted = postings.weights(lexical.query_terms(asked), s).cache()
    frequent = F.col("df") > s.n / 10
    needed, _ = postings.needed_blocks(weighted, s, 10)
    there = postings._blocks(weighted, s).where(frequent).count()
    assert there > 1000 and needed.where(frequent).count() < there / 2


def clusters(seed, n=900, dim=12):
    rs = np.random.RandomState(seed)
    centres = rs.randn(12, dim) * 2
    return centres[rs.randint(0, 12, n)] + rs.randn(n, dim) * 0.6


def test_vector_index(spark, tmp_path):
    x = clusters(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 12), (1002, [1.0, 2.0]), (1003, x[0].tolist()), (1004, (x[0] * 3).tolist())]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clusters(1, 40))] + [(77, None)], "query_id long, embedding array<double>")
    at = f"file://{tmp_path}/cells"
    vector_index.build(vecs, at)
    want = sorted(map(tuple, vector.knn(q, vecs.where("size(embedding) = 12"), 10).collect()))
    assert sorted(map(tuple, vector_index.search(q, at, 10, probes=2).collect())) == want
    near = {(r.query_id, r.vec_id) for r in vector_index.search(q, at, 10, probes=4, exact=False).collect()}
    assert len(near & {(w[0], w[2]) for w in want}) >= 0.9 * len(want)
    assert vector_index.search(q.limit(0), at).collect() == []
    few = vecs.where("vec_id < 3")
    vector_index.build(few, f"file://{tmp_path}/few")
    assert sorted(map(tuple, vector_index.search(q, f"file://{tmp_path}/few").collect())) == sorted(map(tuple, vector.knn(q, few).collect()))


def test_hubs_are_split_and_edges_stay(spark):
    """A node of 300 edges lies in parts of about 40; searches give what they give without a layout of parts, a hop moves its
    frontier alone, and no part holds the hub."""
    from evidence_engine.operators import graph

    rng = random.Random(2)
    pairs = {(0, k) for k in range(1, 301)} | {tuple(rng.sample(range(301), 2)) for _ in range(400)} | {(5, 5)}
    rows = [(i, a, b, "R", round(rng.random(), 2)) for i, (a, b) in enumerate(sorted(pairs))]
    edges = spark.createDataFrame(rows, "edge_id long, source long, target long, relation string, confidence double")
    whole, split = graph.lay_out(edges, hub=10_000, buckets=4), graph.lay_out(edges, hub=40, buckets=4)
    assert whole.hubs.count() == 0 and {r.node_id for r in split.hubs.collect()} == {0}
    sizes = {r["part"]: r["count"] for r in split.rows.where("node_id = 0").groupBy("part").count().collect()}
    assert len(sizes) >= 7 and max(sizes.values()) < 80 and split.rows.count() == whole.rows.count()
    start = spark.createDataFrame([(q, q) for q in range(0, 60, 5)], "query_id long, node_id long")
    goal = spark.createDataFrame([(q, (q * 7 + 3) % 301) for q in range(0, 60, 5)], "query_id long, node_id long")
    for search in (lambda e: graph.ego(start, e, 5), lambda e: graph.k_hop(start, e, 2), lambda e: graph.subgraph(start, e, 2, 20), lambda e: graph.paths(start, goal, e, 3, 8)):
        assert sorted(map(tuple, search(whole).collect()), key=repr) == sorted(map(tuple, search(split).collect()), key=repr)
    assert graph.paths(start, goal, split, 3, 8).count() > 0
    # Without broadcasts, as with large frontiers: the stored edges are read by bucket, not dealt out anew.
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(was, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        frontier = start.join(split.hubs, "node_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        plan = frontier.join(split.rows, ["node_id", "part"])._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "SelectedBucketsCount: 4 out of 4" in plan
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(node_id" in line and ", part" in line]
        assert len(moved) == 1
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_later_rounds_read_what_is_left(spark):
    """Of six queries two need one piece, two need three, one needs six and one is never answered."""
    from evidence_engine.operators import evidence

    need = {1: 1, 2: 1, 3: 3, 4: 3, 5: 6, 6: 99}
    words = "alpha beta gamma delta"
    queries = spark.createDataFrame([(q, words) for q in need], "query_id long, text string")
    asked = []

    def retrieve(frontier, depth):
        ids = sorted(r.query_id for r in frontier.collect())
        asked.append((depth, ids))
        rows = [(q, k, (words if depth >= need[q] else "nothing") + " x" * 800) for q in ids for k in range(1, depth + 1)]
        return spark.createDataFrame(rows, "query_id long, place int, content string")

    got = {r.query_id: r for r in evidence.corrective_rounds(queries, retrieve, (1, 3, 6, 8)).collect()}
    assert asked == [(1, [1, 2, 3, 4, 5, 6]), (3, [3, 4, 5, 6]), (6, [5, 6]), (8, [6])]
    assert {q: r["round"] for q, r in got.items()} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 4}
    assert got[5].sufficient and not got[6].sufficient and got[6].action == "web_verify"
    asked.clear()
    assert evidence.corrective_rounds(queries.where("query_id < 3"), retrieve, (1, 3, 6)).count() == 2 and len(asked) == 1


def test_claims_meet_few_pieces(spark):
    """The overlap join against all pairs, on evidence of which most shares frequent terms only; candidates are counted."""
    from evidence_engine.operators import evidence

    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "abc" for b in "xyz" for c in ("tan", "rok", "mil")]
    often = ["common", "words"]
    text = lambda n: " ".join(rng.choices(words, k=n) + often)
    claims = [(q, k, text(rng.choice([0, 3, 6, 10])) if k else "??") for q in range(6) for k in range(4)] + [(6, 1, "词语 数据"), (6, 2, "图谱")]
    pieces = [(q, f"e{k}", k, rng.choice([None, "Title"]), text(rng.randint(1, 8)).upper()) for q in range(6) for k in range(1, 9)] + [(6, "z", 1, "", "关于数据与词语"), (6, "y", 2, None, "xx")]
    c = spark.createDataFrame(claims, "query_id long, claim_no int, claim string")
    e = spark.createDataFrame(pieces, "query_id long, evidence_id string, place int, title string, content string")
    terms = {(r.query_id, r.claim_no): r.t for r in c.select("query_id", "claim_no", evidence.claim_terms(F.col("claim")).alias("t")).collect()}
    want = set()
    for (q, k), ts in terms.items():
        for p, i, place, title, content in pieces:
            body = " ".join(x for x in (title, content) if x is not None).lower()
            if p == q and (place == 1 if not ts else sum(t in body for t in ts) >= max(1, min(2, len(ts) // 4))):
                want.add((q, k, i, place))
    assert {tuple(r) for r in evidence.match_claims(c, e).collect()} == want
    assert evidence.claim_candidates(c, e).count() < sum(1 for q, k in terms for p in pieces if p[0] == q)
