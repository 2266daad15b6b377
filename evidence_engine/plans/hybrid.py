"""Queries of hybrid retrieval over all four routes with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_engine.functions import text as tx
from evidence_engine.operators import fusion, hybrid
from evidence_engine.operators.routing import rule_plan
from evidence_engine.plans import stored
from evidence_engine.plans.routing import _plan_sql
from evidence_engine.plans.search import _BM25, nearest_sql
from evidence_engine.sources.literals import values_sql
from evidence_engine.sources.scratch import kept
from evidence_engine.sources.tables import CTES, query_set

#: Questions that name nodes of the graph, beside the benchmark's texts, so that every route and method has hits.
QUESTIONS = [
    (1_000_001, "NATION_3 和 EUROPE 之间的关系"), (1_000_002, "围绕 Supplier 的模块"), (1_000_003, "gizmo 如何影响 NATION_1"), (1_000_004, "解释 anvil 的原理"), (1_000_005, "gear 优化架构"), (1_000_006, "总结一下整体框架 plate"),
    (1_000_007, "hi"), (1_000_008, "AMERICA 上下游"), (1_000_009, "今天天气不错呢"), (1_000_010, "NATION_7"),
]


def asked(spark, sf):
    """The benchmark's texts and the literal questions."""
    return query_set(spark, sf).select(F.col("query_id").cast("long"), "text").unionByName(spark.createDataFrame(QUESTIONS, "query_id long, text string"))


def inputs(spark, sf):
    """(queries, plans, hits): the plans of all queries and the four routes' hits."""
    q = kept(asked(spark, sf), "hybrid-queries")
    plans, docs = kept(rule_plan(q), "hybrid-plans"), stored.stored_chunks(spark, sf)
    hits = hybrid.routes(q, plans, docs, stored.chunk_vectors(spark, sf), stored.nodes_of(spark, sf), stored.edges_of(spark, sf), top_k=8, near=stored.adjacency_of(spark, sf))
    return q, plans, kept(hits, "hybrid-hits")


def hybrid_hits(spark, sf):
    """How many hits each route gives each query, and which kinds."""
    _, _, hits = inputs(spark, sf)
    return hits.groupBy("query_id", "route", "result_type").agg(F.count("*").alias("n"), F.sum("rank").alias("ranks"), F.min("hit_key").alias("least"))


def route_weights(spark, sf):
    w = fusion.route_weights(rule_plan(asked(spark, sf)))
    return w.select("query_id", *(tx.scaled(F.col(c)).alias(c) for c in ("w_bm25", "w_vector", "w_entity", "w_graph")))


_TERM = "'[A-Za-z_][A-Za-z0-9_]{2,}|[一-龥]{2,6}'"
_ASKED = f"qs AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT CAST(query_id AS BIGINT), text FROM {values_sql(QUESTIONS, 'query_id, text')})"
_PLANS = f", plans AS ({_plan_sql('qs')})"
_WEIGHTS = r""", wt AS (SELECT *, regexp_matches(text, '[A-Za-z_][A-Za-z0-9_]{3,}|[A-Z]{2,}|[一-龥]{2,6}') AS exact_terms, graph_method IN ('path', 'subgraph') AS deep,
    intent IN ('relation', 'path', 'subgraph') OR graph_method IN ('path', 'subgraph') AS is_rel,
    intent IN ('explain', 'semantic', 'global_summary', 'optimize') OR regexp_matches(text, '为什么|如何|怎么|原理|机制|优势|区别|作用|适合') AS is_sem FROM plans),
w0 AS (SELECT *, CASE WHEN is_rel THEN [0.9, 0.9, 0.9, 1.8] WHEN is_sem THEN [0.85, 1.55, 0.45, 0.45] WHEN intent IN ('fact', 'exact') OR exact_terms THEN [1.55, 0.95, 0.9, 0.55] ELSE [1.0, 1.0, 0.7, 0.7] END::DOUBLE[] AS w FROM wt),
w2 AS (SELECT *, w[1] + CASE WHEN exact_terms THEN 0.25 ELSE 0 END::DOUBLE AS w_bm25, w[2] AS w_vector, w[3] AS w_entity, CASE WHEN intent = 'global_summary' THEN 0.2 ELSE w[4] + CASE WHEN deep THEN 0.35 ELSE 0 END END::DOUBLE AS w_graph FROM w0)"""
_M = "CAST(floor({0} * 1e6 + 0.5) AS BIGINT) AS {0}"
ROUTE_WEIGHTS = "WITH " + _ASKED + _PLANS + _WEIGHTS + f" SELECT query_id, {', '.join(_M.format(c) for c in ('w_bm25', 'w_vector', 'w_entity', 'w_graph'))} FROM w2"

#: Seeds, and from them the graph's hits: nodes found by name first, then the nodes of the plan's names.
_SEEDS = f""", nd AS (SELECT *, 0.5::DOUBLE + (node_id * 7 % 50) / 100.0::DOUBLE AS conf FROM g_nodes),
tt AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) AS k FROM (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS i FROM (SELECT query_id, regexp_extract_all(text, {_TERM}) AS ts FROM qs)) GROUP BY query_id, term),
et AS (SELECT DISTINCT query_id, lower(term) AS term FROM tt WHERE k <= 8),
en AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY node_id) AS rank FROM (SELECT DISTINCT query_id, node_id FROM et JOIN g_nodes ON name ILIKE '%' || term || '%')),
ent AS (SELECT en.* FROM en JOIN plans USING (query_id) WHERE rank <= least(20, greatest(8, coalesce(nullif(graph_top_k, 0), 5)))),
nm AS (SELECT query_id, regexp_extract_all(text, '[一-龥a-zA-Z0-9_.-]{{2,}}')[1:8] AS ns FROM plans WHERE rule <> 'exact'),
nk AS (SELECT query_id, lower(term) AS term, k FROM tt JOIN plans USING (query_id) WHERE rule = 'exact' AND k <= 8 UNION ALL SELECT query_id, lower(unnest(ns)), generate_subscripts(ns, 1) FROM nm),
nt AS (SELECT term, node_id, row_number() OVER (PARTITION BY term ORDER BY conf DESC, node_id) AS n FROM (SELECT DISTINCT term FROM nk) JOIN nd ON name ILIKE '%' || term || '%'),
sa AS (SELECT query_id, node_id, 0 AS k, rank AS n FROM ent UNION ALL SELECT query_id, node_id, k, n FROM nk JOIN nt USING (term) WHERE n <= 5),
sf AS (SELECT query_id, node_id, min((k, n)) AS spot FROM sa GROUP BY ALL),
seeds AS (SELECT query_id, node_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot) AS place FROM sf) WHERE place <= 8)"""
_GRAPH = """, ask AS (SELECT query_id, graph_method AS m, least(greatest(graph_depth, 2), 3) AS pd, least(greatest(graph_depth, 1), 2) AS sd, coalesce(nullif(graph_top_k, 0), 8) AS k FROM plans WHERE graph_method <> 'none'),
g1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, edge_id) AS r FROM (SELECT DISTINCT query_id, edge_id, confidence FROM seeds JOIN ask USING (query_id) JOIN incident USING (node_id))),
fan AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY confidence DESC, edge_id) AS r FROM incident) WHERE r <= 20),
goal AS (SELECT query_id, node_id FROM seeds WHERE place > 1),
p0 AS (SELECT query_id, node_id, [node_id] AS nodes, CAST([] AS BIGINT[]) AS es, CAST([] AS BIGINT[]) AS ord FROM seeds JOIN ask USING (query_id) WHERE place = 1 AND m = 'path'),
p1 AS (SELECT query_id, other_id AS node_id, list_append(nodes, other_id) AS nodes, list_append(es, edge_id) AS es, list_append(ord, r) AS ord FROM p0 JOIN fan USING (node_id) WHERE NOT list_contains(nodes, other_id)),
p2 AS (SELECT query_id, other_id AS node_id, list_append(nodes, other_id) AS nodes, list_append(es, edge_id) AS es, list_append(ord, r) AS ord FROM p1 JOIN fan USING (node_id) WHERE NOT list_contains(nodes, other_id) AND NOT EXISTS (SELECT 1 FROM goal WHERE goal.query_id = p1.query_id AND goal.node_id = p1.node_id)),
p3 AS (SELECT query_id, other_id AS node_id, list_append(nodes, other_id) AS nodes, list_append(es, edge_id) AS es, list_append(ord, r) AS ord FROM p2 JOIN fan USING (node_id) JOIN ask USING (query_id) WHERE pd = 3 AND NOT list_contains(nodes, other_id) AND NOT EXISTS (SELECT 1 FROM goal WHERE goal.query_id = p2.query_id AND goal.node_id = p2.node_id)),
ph AS (SELECT x.*, row_number() OVER (PARTITION BY x.query_id ORDER BY hops, ord, nodes) AS rank FROM (SELECT *, 1 AS hops FROM p1 UNION ALL SELECT *, 2 FROM p2 UNION ALL SELECT *, 3 FROM p3) x JOIN goal ON goal.query_id = x.query_id AND goal.node_id = x.node_id),
f1 AS (SELECT DISTINCT g1.query_id, i.other_id AS node_id FROM g1 JOIN ask USING (query_id) JOIN incident i USING (edge_id) JOIN seeds s ON s.query_id = g1.query_id AND s.node_id = i.node_id
  WHERE m = 'subgraph' AND sd = 2 AND g1.r <= 60 AND NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query_id = g1.query_id AND x.node_id = i.other_id)),
g2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, edge_id) AS r FROM (SELECT DISTINCT query_id, edge_id, confidence FROM f1 JOIN incident USING (node_id))),
sg AS (SELECT query_id, edge_id, row_number() OVER (PARTITION BY query_id ORDER BY hop, r) AS rank FROM (SELECT query_id, edge_id, r, 1 AS hop FROM g1 WHERE r <= 60 UNION ALL SELECT query_id, edge_id, r, 2 FROM g2 WHERE r <= 60)),
gh AS (
  SELECT query_id, r AS rank, 'ego' AS kind, CAST(edge_id AS VARCHAR) AS item, [edge_id] AS es FROM g1 JOIN ask USING (query_id) WHERE r <= k AND (m = 'ego' OR (m = 'path' AND query_id NOT IN (SELECT query_id FROM ph)))
  UNION ALL SELECT query_id, rank, 'path', 'path:' || array_to_string(es, ':'), es FROM ph JOIN ask USING (query_id) WHERE rank <= k
  UNION ALL SELECT query_id, rank, 'subgraph', CAST(edge_id AS VARCHAR), [edge_id] FROM sg JOIN ask USING (query_id) WHERE m = 'subgraph' AND rank <= k),
gl AS (SELECT query_id, rank, kind, item, unnest(es) AS edge_id, generate_subscripts(es, 1) AS leg FROM gh),
gn AS (SELECT query_id, rank, kind, item, string_agg(s.name || ' -' || relation || '-> ' || t.name, ' | ' ORDER BY leg) AS title FROM gl JOIN g_edges USING (edge_id) JOIN g_nodes s ON s.node_id = source JOIN g_nodes t ON t.node_id = target GROUP BY ALL)"""
_HITS = _SEEDS + _GRAPH + _BM25 % "qs" + nearest_sql("qs") + """, hits AS (
  SELECT query_id, 0 AS route_no, 'bm25' AS route, rank, 'chunk' AS kind, 'chunk:' || chunk_id AS hit_key, c.source AS title, content FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) JOIN chunks c USING (chunk_id) JOIN plans USING (query_id) WHERE rank <= bm25_top_k
  UNION ALL SELECT query_id, 1, 'vector', rank, 'chunk', 'chunk:' || chunk_id, c.source, content FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs) JOIN chunks c USING (chunk_id) JOIN plans USING (query_id) WHERE rank <= vector_top_k
  UNION ALL SELECT query_id, 2, 'entity', rank, 'node', 'node:' || node_id, name, '' FROM ent JOIN g_nodes USING (node_id)
  UNION ALL SELECT query_id, 3, 'graph', rank, kind, CASE WHEN kind = 'path' THEN item ELSE 'edge:' || item END, title, title FROM gn)"""
_ALL = "WITH " + ",\n".join([CTES[c] for c in ("chunks", "g_nodes", "g_edges", "incident")] + [_ASKED]) + _PLANS + _HITS
HITS = _ALL + " SELECT query_id, route, kind AS result_type, count(*) AS n, CAST(sum(rank) AS BIGINT) AS ranks, min(hit_key) AS least FROM hits GROUP BY ALL"


def hybrid_search(spark, sf):
    q, plans, hits = inputs(spark, sf)
    return hybrid.search(q, plans, hits)


_BOOST = _WEIGHTS + """, kx AS (SELECT query_id, term, min(i) AS i FROM (SELECT query_id, unnest(ks) AS term, generate_subscripts(ks, 1) AS i FROM (SELECT query_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}|[A-Z]{2,}|[一-龥]{2,6}') AS ks FROM qs)) GROUP BY query_id, term),
kd AS (SELECT query_id, list(lower(term) ORDER BY i) AS ks FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS k FROM kx) WHERE k <= 10 GROUP BY query_id),
b AS (SELECT h.*, w2.w_bm25, w2.w_vector, w2.w_entity, w2.w_graph, least(0.012::DOUBLE, len(list_filter(coalesce(ks, []), lambda x: contains(lower(title), x))) * 0.004::DOUBLE)
    + CASE WHEN route = 'bm25' THEN least(0.01::DOUBLE, len(list_filter(coalesce(ks, []), lambda x: contains(lower(title || chr(10) || content), x))) * 0.002::DOUBLE) ELSE 0 END
    + CASE WHEN route = 'graph' AND deep THEN 0.004 ELSE 0 END::DOUBLE - CASE WHEN route IN ('entity', 'graph') AND intent IN ('explain', 'semantic', 'global_summary') THEN 0.004 ELSE 0 END::DOUBLE AS boost
  FROM hits h JOIN w2 USING (query_id) LEFT JOIN kd USING (query_id))"""
_FUSE = _BOOST + """, f AS (SELECT query_id, hit_key, sum(CASE route WHEN 'bm25' THEN w_bm25 WHEN 'vector' THEN w_vector WHEN 'entity' THEN w_entity ELSE w_graph END / (60 + rank) + boost) AS total, min(route_no * 1000 + rank) AS first_seen, string_agg(route, ',' ORDER BY route_no) AS routes FROM b GROUP BY query_id, hit_key)"""
HYBRID = _ALL + _FUSE + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, hit_key, CAST(floor(total * 1e6 + 0.5) AS BIGINT) AS score, routes FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(total * 1e6 + 0.5) DESC, first_seen) AS rank FROM f) WHERE rank <= 8"""


def hit_boost(spark, sf):
    """Each hit's boost, and what it would be if paragraphs of a kind were preferred."""
    q, plans, hits = inputs(spark, sf)
    terms = q.select("query_id", tx.query_terms(F.col("text")).alias("terms"))
    rows = hits.withColumn("chunk_type", F.when(F.col("result_type") == "chunk", F.when(F.col("rank") % 3 == 0, "method").when(F.col("rank") % 3 == 1, "table").otherwise("paragraph")))
    rows = rows.join(terms, "query_id").join(plans.select("query_id", "intent", "graph_method"), "query_id")
    liked = F.array(F.lit("abstract"), F.lit("method"), F.lit("table"))
    return rows.select("query_id", "route", "rank", tx.scaled(fusion.hit_boost()).alias("boost"), tx.scaled(fusion.hit_boost(liked)).alias("preferred"))


HIT_BOOST = _ALL + _BOOST + """ SELECT query_id, route, CAST(rank AS INTEGER) AS rank, CAST(floor(boost * 1e6 + 0.5) AS BIGINT) AS boost,
  CAST(floor((boost + CASE WHEN kind <> 'chunk' THEN 0 WHEN rank % 3 = 0 THEN 0.027 WHEN rank % 3 = 1 THEN 0.024 ELSE -0.004 END::DOUBLE) * 1e6 + 0.5) AS BIGINT) AS preferred FROM b"""


def rrf_fuse(spark, sf):
    """The same hits with all weights 1 and no boost."""
    return fusion.rrf(inputs(spark, sf)[2], top_k=8)


RRF = _ALL + """, f AS (SELECT query_id, hit_key, sum(1.0::DOUBLE / (60 + rank)) AS total, min(route_no * 1000 + rank) AS first_seen FROM hits GROUP BY query_id, hit_key)
SELECT query_id, CAST(rank AS INTEGER) AS rank, hit_key, CAST(floor(total * 1e6 + 0.5) AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(total * 1e6 + 0.5) DESC, first_seen) AS rank FROM f) WHERE rank <= 8"""


def context_text(spark, sf):
    _, plans, hits = inputs(spark, sf)
    return hybrid.context_text(plans, hits)


CONTEXT = _ALL + """, d1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, hit_key ORDER BY route_no, rank) AS f FROM hits WHERE route_no < 2),
d2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY route_no, rank) AS n FROM d1 WHERE f = 1),
ln AS (SELECT query_id, 0 AS s, n AS k, '- ' || title || ' [chunk ]: ' || substring(content, 1, 400) AS line FROM d2 WHERE n <= 6
  UNION ALL SELECT query_id, 1, rank, '- 【' || type || '】' || title || ': ' FROM hits JOIN g_nodes ON hit_key = 'node:' || node_id WHERE rank <= 5 AND route = 'entity'
  UNION ALL SELECT query_id, 2, rank, '- ' || title FROM hits WHERE route = 'graph' AND rank <= 6),
sc AS (SELECT query_id, s, ['【文档证据】', '【实体证据】', '【图谱证据】'][s + 1] || chr(10) || string_agg(line, chr(10) ORDER BY k) AS part FROM ln GROUP BY query_id, s)
SELECT p.query_id, '【用户问题】' || p.text || chr(10) || '【检索理解】' || p.text || chr(10) || '【问题意图】' || intent || coalesce(chr(10) || string_agg(part, chr(10) ORDER BY s), '') AS context
FROM plans p LEFT JOIN sc USING (query_id) GROUP BY p.query_id, p.text, intent"""


def kg_search(spark, sf):
    """Entities and relations of a search in the graph, as one list."""
    q, plans, hits = inputs(spark, sf)
    entities, relations = hybrid.kg_search(hybrid.search(q, plans, hits), hits, stored.nodes_of(spark, sf), stored.edges_of(spark, sf))
    a = entities.select("query_id", F.lit("entity").alias("kind"), "rank", "name")
    return a.unionByName(relations.select("query_id", F.lit("relation").alias("kind"), "rank", F.concat_ws(" ", "source_name", "relation", "target_name").alias("name")))


KG_SEARCH = _ALL + _FUSE + """, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(total * 1e6 + 0.5) DESC, first_seen) AS rank FROM f)
SELECT query_id, 'entity' AS kind, CAST(rank AS INTEGER) AS rank, name FROM top JOIN g_nodes ON hit_key = 'node:' || node_id WHERE rank <= 8
UNION ALL SELECT query_id, 'relation', CAST(rank AS INTEGER), s.name || ' ' || relation || ' ' || t.name FROM gh JOIN g_edges ON item = CAST(edge_id AS VARCHAR) JOIN g_nodes s ON s.node_id = source JOIN g_nodes t ON t.node_id = target WHERE kind <> 'path'"""


def pipeline_retriever(spark, sf):
    """What the next stage gets: how many entities and chunks each query has."""
    q, plans, hits = inputs(spark, sf)
    entities, found = hybrid.retrieved(hybrid.search(q, plans, hits, 10), hits)
    n = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    return q.select("query_id").join(n(entities, "entities"), "query_id", "left").join(n(found, "chunks"), "query_id", "left").na.fill(0)


PIPELINE_RETRIEVER = _ALL + _FUSE + """, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(total * 1e6 + 0.5) DESC, first_seen) AS rank FROM f),
e AS (SELECT query_id, count(*) AS n FROM top WHERE rank <= 10 AND hit_key NOT LIKE 'chunk:%' GROUP BY query_id), c AS (SELECT query_id, count(*) AS n FROM hits WHERE route_no < 2 GROUP BY query_id)
SELECT query_id, coalesce(e.n, 0) AS entities, coalesce(c.n, 0) AS chunks FROM qs LEFT JOIN e USING (query_id) LEFT JOIN c USING (query_id)"""


def retrieval_stats(spark, sf):
    q, plans, hits = inputs(spark, sf)
    return hybrid.retrieval_stats(hits, hybrid.search(q, plans, hits))


STATS = _ALL + """, m AS (SELECT query_id, least(8, count(DISTINCT hit_key)) AS merged FROM hits GROUP BY query_id)
SELECT query_id, count(*) FILTER (WHERE route = 'bm25') AS bm25_hits, count(*) FILTER (WHERE route = 'vector') AS semantic_hits, count(*) FILTER (WHERE route = 'graph') AS graph_hits, any_value(merged) AS merged FROM hits JOIN m USING (query_id) GROUP BY query_id"""

QUERIES = {f.__name__: f for f in (hybrid_hits, route_weights, hit_boost, rrf_fuse, hybrid_search, context_text, kg_search, pipeline_retriever, retrieval_stats)}
ORACLES = {"hybrid_hits": HITS, "route_weights": ROUTE_WEIGHTS, "hit_boost": HIT_BOOST, "rrf_fuse": RRF, "hybrid_search": HYBRID, "context_text": CONTEXT, "kg_search": KG_SEARCH, "pipeline_retriever": PIPELINE_RETRIEVER, "retrieval_stats": STATS}
