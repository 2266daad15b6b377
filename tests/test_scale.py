"""Operators that meet large groups: what they list must not grow with pairs, and results stay those of the plain way."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from evidence_engine.operators import graph, lexical, vector, vector_index
from evidence_engine.plans import evidence, hybrid, stored


def hubs(spark):
    """Two hubs that most nodes are next to, random edges between nodes, a self-loop, and nodes beside the rest."""
    rnd = random.Random(5)
    pairs = [(n, h) for n in range(10, 90) for h in (1, 2) if rnd.random() < 0.6] + [(rnd.randrange(10, 100), rnd.randrange(10, 100)) for _ in range(120)] + [(10, 10), (200, 201), (1, 2)]
    rows = [(k, a, b, rnd.randrange(50, 60) / 100) for k, (a, b) in enumerate(sorted(set(pairs)))]
    return spark.createDataFrame(rows, "edge_id long, source long, target long, confidence double"), rows


def test_totals_of_hops_are_those_of_all_pairs(spark):
    edges, _ = hubs(spark)
    seeds = spark.createDataFrame([(n, n) for n in range(10, 60)] + [(900, 1), (901, 200), (902, 12), (902, 200), (903, 777)], "query_id long, node_id long")
    for kind in ({"wide": 20}, {"wide": 3, "hub": 15}, {"wide": 10_000}):
        laid = graph.lay_out(edges, buckets=4, **kind)
        for depth in (1, 2, 3):
            want = graph.k_hop(seeds, laid, depth).groupBy("query_id", "hop").agg(F.count("*"), F.sum("node_id"))
            assert sorted(map(tuple, graph.k_hop_totals(seeds, laid, depth).collect())) == sorted(map(tuple, want.collect()))


def test_lists_of_the_last_hop_travel_once_a_run(spark, monkeypatch):
    """Endpoints alone are laid out, a node's list goes to all queries of a run at once, and totals stay those of all pairs,
    also where a query is told apart in slices and nodes of classes are many."""
    edges, _ = hubs(spark)
    seeds = spark.createDataFrame([(n, n) for n in range(10, 60)] + [(900, 1), (901, 200), (902, 12), (902, 200), (903, 777)], "query_id long, node_id long")
    want = {d: sorted(map(tuple, graph.k_hop(seeds, graph.lay_out(edges, buckets=4), d).groupBy("query_id", "hop").agg(F.count("*"), F.sum("node_id")).collect())) for d in (1, 2, 3)}
    stored, kept, lay_out = {}, graph.kept, graph.lay_out
    monkeypatch.setattr(graph, "kept", lambda df, tag: stored.setdefault(tag, []).append(kept(df, tag)) or stored[tag][-1])
    monkeypatch.setattr(graph, "lay_out", lambda e, **kind: stored.setdefault("laid", []).append(lay_out(e, buckets=4, wide=20, **kind)) or stored["laid"][-1])
    for bits, pairs, few in ((9, 1 << 23, 1 << 20), (2, 200, 0)):
        monkeypatch.setattr(graph, "RUN_BITS", bits)
        monkeypatch.setattr(graph, "PART_PAIRS", pairs)
        monkeypatch.setattr(graph, "FEW_SHARED", few)
        for d in (1, 2, 3):
            assert sorted(map(tuple, graph.k_hop_totals(seeds, edges, d).collect())) == want[d]
    assert all(set(laid.rows.columns) == {"node_id", "part", "other_id"} for laid in stored["laid"])
    near = stored["graph-near"][1]
    asked = near.select(F.explode("queries").alias("query_id"), "node_id").collect()
    assert near.count() == len({(r.query_id >> 9, r.node_id) for r in asked}) < len(asked) == len(set(asked))


def test_a_hop_reads_the_first_edges_of_each_node_alone(spark, monkeypatch):
    edges, rows = hubs(spark)
    laid, seeds = graph.lay_out(edges, buckets=4, wide=20), spark.createDataFrame([(n, n) for n in range(10, 40)], "query_id long, node_id long")
    met, step = [], graph.step
    monkeypatch.setattr(graph, "step", lambda *a: met.append(step(*a)) or met[-1])
    got = sorted(map(tuple, graph.subgraph(seeds, laid, 2, 3).collect()))
    assert max(r["count"] for m in met for r in m.groupBy("query_id", "node_id").count().collect()) == 9
    best = lambda found: sorted(found, key=lambda e: (-e[3], e[0]))[:9]
    want = []
    for q in range(10, 40):
        one = best({e for e in rows if q in e[1:3]})
        near = {n for e in one for n in e[1:3]} - {q}
        two = best({e for e in rows if near & set(e[1:3])})
        want += [(q, k + 1, h, e[0]) for k, (h, e) in enumerate([(1, e) for e in one] + [(2, e) for e in two]) if k < 3]
    assert got == sorted(want)
    places = {(r.node_id, r.edge_id): (r.other_id, r.r, r.r_back) for r in laid.rows.collect()}
    assert all(places[o, e][1] == back for (n, e), (o, _, back) in places.items())


def test_chunks_stream_past_passes_of_queries(spark, monkeypatch):
    """In passes of a few terms and tiles of a few chunks, with copies, empty chunks and terms that no chunk holds."""
    rnd = random.Random(3)
    words = [f"w{chr(97 + k)}" for k in range(26)] + ["12", "数据"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [text(rnd.randrange(1, 12)) for _ in range(60)] * 2 + ["", "?!"]
    rows = [(k, t, len(t)) for k, t in enumerate(texts)] + [(900, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, token_count int").repartition(3)
    queries = [(q, v, text(rnd.randrange(1, 4)) + (" absent" if q % 5 == 0 else "")) for q in range(12) for v in (0, 1)] + [(50, 0, "absent"), (51, 0, ""), (52, 1, None)]
    asked = spark.createDataFrame(queries, "query_id long, variant int, text string")
    monkeypatch.setattr(lexical, "PASS_TERMS", 9)
    monkeypatch.setattr(lexical, "TILE", 7)
    df = Counter(w for _, t, _ in rows for w in set((t or "").replace("?!", "").split()))
    sizes = [max(1, n or len(t or "")) for _, t, n in rows]
    n, avgdl = len(rows), sum(sizes) / len(rows)
    for partial in (True, False):
        want = set()
        for q, v, t in queries:
            qtf, found = Counter((t or "").split()), []
            for (c, body, _), size in zip(rows, sizes, strict=True):
                tf = Counter((body or "").split())
                met = [w for w in qtf if tf[w]]
                if met and (partial or sum(qtf[w] for w in met) >= len(qtf)):
                    s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * 2.5 * qtf[w] * tf[w] / (tf[w] + 1.5 * (0.25 + 0.75 * size / avgdl)) for w in met)
                    found.append((-math.floor(s * 1e6 + 0.5), c))
            want |= {(q, v, r, c, -s) for r, (s, c) in enumerate(sorted(found)[:4], 1)}
        got = lexical.bm25(asked, chunks, 4, partial, ("query_id", "variant"))
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 0


def test_probes_follow_the_vectors(spark, tmp_path):
    """Vectors that are no more alike than chance: 4 of 50 cells hold few neighbours, the fitted number holds 0.9 of them."""
    rnd = random.Random(8)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(24)]) for k in range(2500)]
    vecs, at = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), f"file://{tmp_path}/cells"
    vector_index.build(vecs, at)
    q = vecs.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    want = {(r.query_id, r.vec_id) for r in vector.knn(q, vecs).collect()}
    found = lambda p: {(r.query_id, r.vec_id) for r in vector_index.search(q, at, probes=p, exact=False).collect()}
    assert len(found(4) & want) < 0.9 * len(want) <= len(found(vector_index.probes_for(vecs, at)) & want)


def test_vectors_stream_past_the_queries_of_their_group(spark, monkeypatch):
    """Groups of many, of few and of no vectors, and none at all, in passes and tiles: no join lists pairs of vectors."""
    rnd = random.Random(4)
    vec = lambda: [rnd.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(5)]
    rows = [(k, vec(), rnd.choice([1, 1, 2, 3, None])) for k in range(150)] + [(900, vec(), 4), (901, [0.0] * 5, 5), (902, None, 1), (903, vec()[:4], 2)]
    asked = [(k, vec(), k % 7 or None) for k in range(40)] + [(50, [0.0] * 5, 1), (51, None, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>, label int")
    monkeypatch.setattr(vector, "PASS_BYTES", 400)
    monkeypatch.setattr(vector, "TILE", 7)
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    want = set()
    for q, v, g in asked:
        if not v or not norm(v):
            continue
        met = [(-math.floor(max(0, 1 - (1 - sum(a * b for a, b in zip(v, w, strict=True)) / norm(v) / norm(w)) / 2) * 1e6 + 0.5), i, h) for i, w, h in rows if w and len(w) == 5 and norm(w)]
        own = [m for m in met if g is not None and m[2] == g]
        want |= {(q, r, i, -s, bool(own)) for r, (s, i, _) in enumerate(sorted(own or met)[:4], 1)}
    got = vector.knn_by_group(queries, vectors, 4, "label")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_one_batch_of_queries_builds_no_text_index(spark, sf, monkeypatch):
    """A batch that is searched once streams the chunks; posting all of their terms first costs more than the search."""
    monkeypatch.setattr(stored, "text_index", lambda *a: (_ for _ in ()).throw(AssertionError("an index is built")))
    assert evidence.corrective_loop(spark, sf).count() == 40
    assert hybrid.inputs(spark, sf)[2].where("route = 'bm25'").count() > 0
