"""Retrieval and the paper graph against plain Python, and the service operators' defined cases."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidence_engine.operators import catalog, embedding, graph, lexical, papergraph, policies, vector, workflow
from evidence_engine.plans import evidence, graphs
from evidence_engine.plans.graphs import PAPER_EDGES, PAPER_NODES, PAPER_QUERIES
from evidence_engine.sources.tables import chunks, query_set


def test_variants_keep_apart(spark):
    """A hundred variants of one query, and the next query's first."""
    chunks = spark.createDataFrame([(1, "a b", 3), (2, "c", 1)], "chunk_id long, content string, token_count long")
    rows = [(1, v, "c" if v == 150 else "zzz") for v in range(151)] + [(2, 0, "a")]
    got = lexical.multi_query(spark.createDataFrame(rows, "query_id long, variant int, text string"), chunks).collect()
    assert {(r.query_id, r.chunk_id) for r in got} == {(1, 2), (2, 1)}


def test_a_half_of_a_query_adds_its_own_evidence(spark, sf):
    """What the first half of a text finds beyond the whole one is kept, what both find counts once, at its first place."""
    asked, docs = query_set(spark, sf), chunks(spark, sf)
    whole = lexical.bm25(asked, docs, 5).collect()
    texts = [(r.query_id, r.text[: len(r.text) // 2]) for r in asked.collect()]
    half = lexical.bm25(spark.createDataFrame(texts, "query_id long, text string"), docs, 5).collect()
    first = {}
    for r in sorted(whole, key=lambda r: r.rank) + sorted(half, key=lambda r: r.rank):
        first.setdefault((r.query_id, r.chunk_id), r.rank)
    want = defaultdict(list)
    for (q, _), place in first.items():
        want[q].append(place)
    got = {r.query_id: (r.n, r.places) for r in evidence.evidence_dedupe(spark, sf).collect()}
    assert got == {q: (len(p), sum(p)) for q, p in want.items()}
    assert len(whole) < len(first) < len(whole) + len(half)


def test_named_like_is_ilike(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abAB_ 图谱") for _ in range(rng.randint(0, 7))) for _ in range(150)]
    terms = list({"".join(rng.choice("ab_图谱") for _ in range(rng.randint(1, 4))) for _ in range(40)})
    nodes = spark.createDataFrame(list(enumerate(names)), "node_id long, name string")
    asked = spark.createDataFrame([(t,) for t in terms], "key string")
    like = lambda n, t: any(all(x == "_" or x == y for x, y in zip(t, n.lower()[k : k + len(t)], strict=True)) for k in range(len(n) - len(t) + 1))
    assert {tuple(r) for r in graph.named_like(asked, nodes).collect()} == {(t, i) for t in terms for i, n in enumerate(names) if like(n, t)}
    assert {tuple(r) for r in graph.named_like(asked, nodes, literal=True).collect()} == {(t, i) for t in terms for i, n in enumerate(names) if t in n.lower()}


def test_vectors_in_passes(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(6)]) for i in range(120)] + [(500, [0.0] * 6), (501, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = frame.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    whole = {tuple(r) for r in vector.knn(asked, frame, 4).collect()}
    monkeypatch.setattr(vector, "PASS_BYTES", 100)
    monkeypatch.setattr(vector, "TILE", 7)
    assert {tuple(r) for r in vector.knn(asked, frame, 4).collect()} == whole and len(whole) == 48


def test_embedder(spark):
    rows = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None)], "k long, text string")
    got = {r.k: r.embedding for r in embedding.embed(rows, "k").collect()}
    assert sum(map(abs, got[1])) in (3, 1) and not any(got[2]) and not any(got[3]) and len(got[1]) == embedding.DIM
    assert embedding.embed(rows.limit(0), "k").collect() == []


def test_upsert_of_vectors(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "vec_id long, text string")
    fresh = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "vec_id long, text string, seq int")
    once = vector.upsert(stored, fresh)
    assert {tuple(r) for r in once.collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {tuple(r) for r in vector.upsert(once, fresh).collect()} == {tuple(r) for r in once.collect()}


def plain_search(spark, text, method, depth, seeds, limit):
    """One search over the literal graph of papers, as loops."""
    types, names = {n[0]: n[2] for n in PAPER_NODES}, {n[0]: n[1] for n in PAPER_NODES}
    docs = {n[0]: n[3] for n in PAPER_NODES}
    edges = {e[0]: e for e in PAPER_EDGES}
    near = defaultdict(list)
    for e, s, t, _, c in PAPER_EDGES:
        near[s].append((-c, e, t)), near[t].append((-c, e, s))
    near = {k: sorted(v) for k, v in near.items()}
    one = spark.createDataFrame([(text,)], "text string")
    wanted = one.select(policies.relation_filter(F.col("text"))).first()[0]
    targets = one.select(policies.target_types(F.col("text"))).first()[0]
    if method == "none":
        return []

    def by_confidence(ids):
        return [e for _, e in sorted({(-edges[e][4], e) for n in ids for _, e, _ in near.get(n, ())})]

    def ego(ids):
        return [("ego", str(e)) for e in by_confidence(ids)[:limit]]

    def paths(ids, most):
        queue, found = [([ids[0]], [])], []
        while queue:
            nodes, went = queue.pop(0)
            if len(went) == most:
                continue
            for _, e, n in near.get(nodes[-1], ())[:20]:
                if n in nodes:
                    continue
                if n in ids[1:]:
                    found.append(("path", "path:" + ":".join(map(str, [*went, e]))))
                else:
                    queue.append(([*nodes, n], [*went, e]))
        return found[:limit] or ego(ids)

    import re

    terms = [t.lower() for t in re.findall("[一-龥a-zA-Z0-9_.-]{2,}", text)][:8]

    def rank(e):
        _, s, t, relation, c = edges[e]
        hit = any(w in f"{relation} {names[s]} {names[t]}".lower() for w in terms)
        paper = types[s] in graph.PAPER_NODE_TYPES or types[t] in graph.PAPER_NODE_TYPES
        return (0 if paper else 5, graph.RELATION_PRIORITY.get(relation, 10) - (2 if hit else 0), -c, e)

    if not (any(w in text.lower() for w in papergraph.PAPER_TOKENS) or any(types[s] in graph.PAPER_NODE_TYPES for s in seeds)):
        if method == "path":
            return paths(seeds, min(max(depth, 2), 3))
        if method == "ego":
            return ego(seeds)
        out, now, seen = [], set(seeds), set(seeds)
        for _ in range(min(max(depth, 1), 2)):
            taken = by_confidence(now)[: 3 * limit]
            out += taken
            now = {x for e in taken for x in edges[e][1:3]} - seen
            seen |= now
        return [("subgraph", str(e)) for e in out[:limit]]
    mine = {docs[s] for s in seeds} - {None}
    seeds = ([n for n in sorted(types, reverse=True) if types[n] == "paper" and docs[n] in mine and n not in seeds] + seeds)[:10]
    some = lambda ids, most: [e for e in by_confidence(ids) if not wanted or edges[e][3] in wanted][:most]
    if method == "path" and not targets and len(seeds) > 1:
        return paths(seeds, 3)
    if method == "path":
        queue, found = [([s], []) for s in seeds], []
        while queue:
            nodes, went = queue.pop(0)
            if len(went) == 3:
                continue
            steps = {e: n for _, e, n in near.get(nodes[-1], ())[:30]}
            for e in sorted(steps, key=rank):
                if steps[e] not in nodes:
                    if types[steps[e]] in targets:
                        found.append(("paper_path", "path:" + ":".join(map(str, [*went, e]))))
                    queue.append(([*nodes, steps[e]], [*went, e]))
        if found:
            return found[:limit]
    if method == "ego":
        return [("paper_ego", str(e)) for e in sorted(some(seeds, 4 * limit), key=rank)[:limit]]
    out, now, seen = [], set(seeds), set(seeds)
    for _ in range(min(max(depth, 1), 3)):
        ranked = sorted(some(now, 5 * limit), key=rank)
        out += [e for e in ranked if e not in out]
        now = {x for e in ranked for x in edges[e][1:3]} - seen
        seen |= now
    return [("paper_subgraph", str(e)) for e in out[:limit]]


def test_paper_graph_search(spark, sf):
    got = defaultdict(list)
    for r in sorted(graphs.paper_graph_search(spark, sf).collect()):
        got[r.query_id].append((r.result_type, r.hit_id))
    want = {q: w for q, text, method, depth, seeds in PAPER_QUERIES if (w := plain_search(spark, text, method, depth, seeds, 4))}
    assert dict(got) == want


def test_documents_without_anything(spark):
    docs = spark.createDataFrame([], "doc_id long, title string, content string, source string")
    assert catalog.list_documents(docs, words="x").collect() == []
    keys = spark.createDataFrame([(1,)], "doc_id long")
    assert catalog.get(docs, keys, "doc_id").collect() == []
    m = spark.createDataFrame([], "conv_id long, turn long, role string, content string")
    turns = spark.createDataFrame([(5, "q", "a")], "conv_id long, question string, answer string")
    assert sorted((r.turn, r.role) for r in catalog.append_turns(m, turns).collect()) == [(0, "user"), (1, "assistant")]


def test_append(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    catalog.append(rows, f"file://{tmp_path}/t"), catalog.append(rows, f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 2


@pytest.mark.parametrize("steps,error", [(1, "exceeded max steps"), (5, "")])
def test_state_graph(spark, steps, error):
    rows = spark.createDataFrame([(1, 0)], "run int, n int")
    edges = [("a", "a", F.col("n") < 3)]
    r = workflow.run_graph(rows, {"a": lambda d: d.withColumn("n", F.col("n") + 1)}, edges, "a", max_steps=steps).first()
    assert (r.error, r.n) == (error, min(steps, 3))
