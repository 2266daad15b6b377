"""Hybrid retrieval: the lexical, vector, entity and graph routes of a batch of plans, their hits in one shape, fused.

A hit is (query_id, route, rank, hit_key, result_type, item_id, title, content, source, chunk_type, section_path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions import text as tx
from evidence_engine.operators import fusion, graph, lexical, papergraph, parsing, policies, postings, vector
from evidence_engine.operators.embedding import embed
from evidence_engine.sources.scratch import kept

HIT = ("query_id", "route", "rank", "hit_key", "result_type", "item_id", "title", "content", "source", "chunk_type", "section_path")
# Labels of self-describing chunk text, result types whose hits are edges.
LABELS = {"chunk_type": "类型", "section_path": "章节", "paper_title": "论文", "authors": "作者", "year": "年份", "method_name": "方法", "metric": "指标", "dataset": "数据集"}
EDGE_TYPES = ("ego", "subgraph", "relation")


def hit_key(kind: Column, item: Column) -> Column:
    """What names a hit: chunk:, node: and edge: with their id, a path's own id, any other type with its id."""
    return F.when(kind == "chunk", F.concat(F.lit("chunk:"), item)).when(kind == "node", F.concat(F.lit("node:"), item)).when(kind.isin(*EDGE_TYPES), F.concat(F.lit("edge:"), item)).when(kind == "path", item).otherwise(F.concat(kind, F.lit(":"), item))


def hydrate_vector_hits(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """hits(query_id, rank, vec_id, text, kind, meta_title, meta_source, score) as they are shown, by what is stored:

    a chunk's id (`chunk:7`, or kind doc_chunk) with its chunk and document; the same without a chunk, from the vector's
    text and metadata; a document's number with the document, 1200 characters of it; anything else is no hit. Header
    lines of a chunk's text give its type and section.
    """
    number = F.expr("try_cast(regexp_replace(vec_id, '^chunk:', '') AS BIGINT)")
    is_chunk = F.col("vec_id").startswith("chunk:") | (F.col("kind") == "doc_chunk")
    rows = hits.withColumns({"number": number, "is_chunk": F.coalesce(is_chunk, F.lit(False))})
    c = chunks.select(F.col("chunk_id").alias("number"), F.col("doc_id").alias("chunk_doc"), F.col("content").alias("chunk_content")).withColumn("is_chunk", F.lit(True))
    rows = rows.join(c, ["number", "is_chunk"], "left")
    d = docs.select(F.col("doc_id").alias("document_id"), F.col("title").alias("doc_title"), F.col("content").alias("doc_content"), F.col("source").alias("doc_source"))
    rows = rows.join(d, d.document_id == F.when(F.col("is_chunk"), F.col("chunk_doc")).otherwise(F.col("number")), "left")
    stored = F.col("chunk_content").isNotNull()
    shape = F.when(F.col("is_chunk") & stored, "chunk").when(F.col("is_chunk"), "loose_chunk").when(F.col("document_id").isNotNull(), "document").otherwise("none")
    rows = rows.withColumn("shape", shape).where("shape <> 'none'")
    content = F.when(F.col("shape") == "chunk", F.col("chunk_content")).when(F.col("shape") == "loose_chunk", F.coalesce("text", F.lit(""))).otherwise(F.substring("doc_content", 1, 1200))
    title = F.coalesce("doc_title", "meta_title", F.lit(""))
    header = parsing.header_fields(content, {"chunk_type": LABELS["chunk_type"], "section_path": LABELS["section_path"]})
    return rows.select(
        "query_id", "rank", "shape", F.when(F.col("shape") == "document", "document").otherwise("chunk").alias("result_type"), F.coalesce(F.col("number").cast("string"), F.regexp_replace("vec_id", "^chunk:", "")).alias("item_id"),
        title.alias("title"), content.alias("content"), F.coalesce("doc_source", "meta_source", F.lit("")).alias("source"), *header, "score",
    )


def lexical_hits(queries: DataFrame, plans: DataFrame, chunks: DataFrame, most: int = 20, index: str | None = None) -> DataFrame:
    """query_id, rank, chunk_id of the plans that search by words, as many as each plan wants; from a stored index of the
    chunks where there is one."""
    wanted = plans.where("bm25_top_k > 0").select("query_id", F.col("bm25_top_k").alias("k"))
    asked = queries.join(wanted.select("query_id"), "query_id", "left_semi")
    best = lexical.bm25(asked, chunks, most) if index is None else postings.search(asked, index, most)
    return best.join(wanted, "query_id").where(F.col("rank") <= F.col("k")).select("query_id", "rank", "chunk_id")


def vector_hits(queries: DataFrame, plans: DataFrame, vectors: DataFrame, most: int = 20) -> DataFrame:
    """query_id, rank, chunk_id of the plans that search by vectors(chunk_id, embedding)."""
    wanted = plans.where("vector_top_k > 0").select("query_id", F.col("vector_top_k").alias("k"))
    asked = embed(queries.join(wanted.select("query_id"), "query_id", "left_semi"), "query_id")
    best = vector.knn(asked, vectors.select(F.col("chunk_id").alias("vec_id"), "embedding"), most)
    # A few rows a query: joined with the chunks, they travel and the chunks don't.
    best = kept(best, "vector-hits")
    return best.join(wanted, "query_id").where(F.col("rank") <= F.col("k")).select("query_id", "rank", F.col("vec_id").alias("chunk_id"))


def graph_terms(queries: DataFrame) -> DataFrame:
    """query_id, names that seeds are found by: the plan's entities, or the query's own terms where it has none."""
    own = tx.all_of(F.col("text"), papergraph.EDGE_TERM)
    return queries.select("query_id", F.when(F.size("entities") > 0, F.col("entities")).otherwise(own).alias("names"))


def routes(queries: DataFrame, plans: DataFrame, chunks: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, top_k: int = 10, index: str | None = None, near: graph.Adjacency | None = None) -> DataFrame:
    """The hits of all four routes of queries(query_id, text) under plans(query_id, text, intent, graph_method, *_top_k,
    graph_depth, entities)."""
    text = chunks.select("chunk_id", F.col("source").alias("title"), "content", "source", _column(chunks, "chunk_type"), _column(chunks, "section_path"))

    def of_chunks(found: DataFrame, route: str) -> DataFrame:
        rows = found.join(text, "chunk_id").withColumns({"route": F.lit(route), "result_type": F.lit("chunk"), "item_id": F.col("chunk_id").cast("string")})
        return rows.withColumn("hit_key", hit_key(F.col("result_type"), F.col("item_id"))).select(*HIT)

    none = lambda name: F.lit(None).cast("string").alias(name)
    limit = F.greatest(F.lit(top_k), F.coalesce(F.nullif(F.col("graph_top_k"), F.lit(0)), F.lit(5)))
    named = graph.entity_search(queries, nodes, 20).join(plans.select("query_id", limit.alias("k")), "query_id").where(F.col("rank") <= F.col("k"))
    named = kept(named, "entity-hits")
    entities = named.join(nodes.select("node_id", "name", "type"), "node_id").select(
        "query_id", F.lit("entity").alias("route"), "rank", F.concat(F.lit("node:"), "node_id").alias("hit_key"), F.lit("node").alias("result_type"), F.col("node_id").cast("string").alias("item_id"),
        F.col("name").alias("title"), F.lit("").alias("content"), F.lit("").alias("source"), F.col("type").alias("chunk_type"), none("section_path"),
    )
    seeds = policies.resolve_seeds(graph_terms(plans), nodes, given=named.select("query_id", F.col("rank").alias("place"), "node_id"))
    wanted = F.coalesce(F.nullif(F.col("graph_top_k"), F.lit(0)), F.lit(top_k))
    found = papergraph.search(plans, seeds, nodes, edges, 20, near).join(plans.select("query_id", wanted.alias("k")), "query_id").where(F.col("place") <= F.col("k"))
    found = kept(found, "graph-hits")
    shown = papergraph.describe(found, nodes, edges)
    linked = shown.select(
        "query_id", F.lit("graph").alias("route"), F.col("place").alias("rank"), hit_key(F.col("result_type"), F.col("hit_id")).alias("hit_key"), "result_type", F.col("hit_id").alias("item_id"),
        F.col("name").alias("title"), F.col("name").alias("content"), F.lit("").alias("source"), none("chunk_type"), none("section_path"),
    )
    return of_chunks(lexical_hits(queries, plans, chunks, index=index), "bm25").unionByName(of_chunks(vector_hits(queries, plans, vectors), "vector")).unionByName(entities).unionByName(linked)


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string").alias(name)


def search(queries: DataFrame, plans: DataFrame, hits: DataFrame, top_k: int = 8, preferred: DataFrame | None = None) -> DataFrame:
    """The routes' hits fused: query_id, rank, hit_key, score, routes; preferred(query_id, preferred) lists chunk types."""
    return fusion.fuse(plans, queries, hits, top_k, preferred)


def context_text(plans: DataFrame, hits: DataFrame, docs_most: int = 6, chars: int = 400, entities_most: int = 5, links_most: int = 6) -> DataFrame:
    """query_id, context: the question, how it is understood and meant, and the evidence by kind: documents (lexical ones
    first, each once), entities and links."""
    order = F.when(F.col("route") == "bm25", 0).otherwise(1)
    docs = hits.where(F.col("route").isin("bm25", "vector"))
    first = F.row_number().over(Window.partitionBy("query_id", "hit_key").orderBy(order, "rank"))
    docs = docs.withColumn("o", order).withColumn("f", first).where("f = 1")
    docs = docs.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "rank"))).where(F.col("n") <= docs_most)
    blank = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    doc_line = F.concat(F.lit("- "), blank("title", "未命名文档"), F.lit(" ["), blank("chunk_type", "chunk"), F.lit(" "), F.coalesce("section_path", F.lit("")), F.lit("]: "), F.substring("content", 1, chars))
    names = hits.where((F.col("route") == "entity") & (F.col("rank") <= entities_most))
    name_line = F.concat(F.lit("- 【"), blank("chunk_type", "entity"), F.lit("】"), "title", F.lit(": "), "content")
    links = hits.where((F.col("route") == "graph") & (F.col("rank") <= links_most))
    parts = [
        docs.select("query_id", F.lit(0).alias("s"), F.col("n").alias("k"), doc_line.alias("line")),
        names.select("query_id", F.lit(1).alias("s"), F.col("rank").alias("k"), name_line.alias("line")),
        links.select("query_id", F.lit(2).alias("s"), F.col("rank").alias("k"), F.concat(F.lit("- "), "title").alias("line")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    heads = F.array(*(F.lit(h) for h in ("【文档证据】", "【实体证据】", "【图谱证据】")))
    section = rows.groupBy("query_id", "s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    section = section.select("query_id", "s", F.concat(F.element_at(heads, F.col("s") + 1), F.lit("\n"), "lines").alias("part"))
    body = section.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "part"))), lambda x: x["part"]), "\n").alias("body"))
    head = F.concat_ws("\n", F.concat(F.lit("【用户问题】"), "text"), F.concat(F.lit("【检索理解】"), "text"), F.concat(F.lit("【问题意图】"), "intent"))
    return plans.join(body, "query_id", "left").select("query_id", F.concat_ws("\n", head, "body").alias("context"))


def retrieved(fused: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, chunks) that the pipeline's next stage gets: of the fused hits the nodes, plain edges and paths, and of the
    lexical and vector hits all, in their order. Hits of the paper graph are no entities there."""
    kinds = hits.groupBy("query_id", "hit_key").agg(F.min("result_type").alias("result_type"), F.min("title").alias("name"))
    entities = fused.join(kinds, ["query_id", "hit_key"]).where(F.col("result_type").isin("node", "path", *EDGE_TYPES)).select("query_id", "rank", "hit_key", "name")
    chunks = hits.where(F.col("route").isin("bm25", "vector")).select("query_id", "route", "rank", "hit_key")
    return entities, chunks


def kg_search(fused: DataFrame, hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations): the nodes among the fused hits with their scores, and the edges among the graph's hits by
    their endpoints' names. Paths are no relations."""
    asked = fused.where(F.col("hit_key").startswith("node:")).withColumn("node_id", F.substring("hit_key", 6, 20).cast("bigint"))
    entities = asked.join(nodes.select("node_id", "name", "type"), "node_id").select("query_id", "rank", "node_id", "name", "type", "score")
    single = hits.where((F.col("route") == "graph") & ~F.col("item_id").startswith("path:")).select("query_id", "rank", F.col("item_id").cast("bigint").alias("edge_id"))
    named = graph.hydrate(edges, nodes).select("edge_id", "source_name", "relation", "target_name")
    return entities, single.join(named, "edge_id").select("query_id", "rank", "source_name", "relation", "target_name")


def retrieval_stats(hits: DataFrame, fused: DataFrame) -> DataFrame:
    """query_id, bm25_hits, semantic_hits, graph_hits, merged: how many each route gave a query."""
    n = lambda route: F.count_if(F.col("route") == route)
    per = hits.groupBy("query_id").agg(n("bm25").alias("bm25_hits"), n("vector").alias("semantic_hits"), n("graph").alias("graph_hits"))
    merged = fused.groupBy("query_id").agg(F.count("*").alias("merged"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return per.join(merged, "query_id", "full").select("query_id", *(zero(c) for c in ("bm25_hits", "semantic_hits", "graph_hits", "merged")))
