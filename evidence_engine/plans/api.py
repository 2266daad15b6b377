"""The engine's services as functions over DataFrames: ingest, route, retrieve, answer, list and delete."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.operators import evidence, fusion, graph, lexical, parsing, routing, vector


class Corpus(NamedTuple):
    """What ingest makes of documents(doc_id, title, content)."""

    blocks: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame


def ingest(docs: DataFrame, kind: str = "md", size: int = parsing.MAX_CHARS) -> Corpus:
    """Blocks, chunks and the paper graph of documents; running it again gives the same keys."""
    blocks = parsing.blocks_of(docs, kind)
    parts = parsing.chunks_of(blocks, size)
    chunks = parts.select((F.col("doc_id") * 100_000 + F.col("chunk_index")).alias("chunk_id"), "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_type", "section_path", F.col("text").alias("content"), F.length("text").cast("long").alias("token_count"))
    chunks = chunks.join(docs.select("doc_id", F.col("title").alias("source")), "doc_id")
    key = lambda kind, *cols: F.xxhash64(F.lit(kind), *cols)
    tree = parsing.section_tree(blocks.select("doc_id", "section_path").distinct())
    tested = parsing.method_dataset_metric(blocks)
    node = lambda df, kind, name, *cols: df.select(key(kind, *cols).alias("node_id"), name.alias("name"), F.lit(kind).alias("type"), F.array("doc_id").alias("source_doc_ids"))
    nodes = node(docs, "paper", F.col("title"), F.col("doc_id"))
    nodes = nodes.unionByName(node(tree, "section", F.col("child"), F.col("doc_id"), F.col("child"))).unionByName(node(chunks, "chunk", F.substring("content", 1, 60), F.col("chunk_id")))
    has = tested.where("relation = 'PAPER_HAS_METHOD'")
    nodes = nodes.unionByName(node(has, "method", F.col("target"), F.lower("target")))
    for kind, relation in (("dataset", "METHOD_EVALUATED_ON_DATASET"), ("metric", "METHOD_REPORTED_METRIC")):
        nodes = nodes.unionByName(node(tested.where(F.col("relation") == relation), kind, F.col("target"), F.lower("target")))
    edge = lambda df, src, dst, relation: df.select(src.alias("source"), dst.alias("target"), relation.alias("relation"))
    up = F.when(F.col("parent") == "", key("paper", "doc_id")).otherwise(key("section", "doc_id", "parent"))
    down = key("section", "doc_id", "child")
    edges = edge(tree, up, down, F.when(F.col("parent") == "", "PAPER_HAS_SECTION").otherwise("CHILD_SECTION"))
    edges = edges.unionByName(edge(tree.where("parent <> ''"), down, up, F.lit("PARENT_SECTION")))
    edges = edges.unionByName(edge(chunks.where("section_path <> ''"), key("section", "doc_id", "section_path"), key("chunk", "chunk_id"), F.lit("SECTION_HAS_CHUNK")))
    chain = parsing.chunk_chain(chunks)
    edges = edges.unionByName(edge(chain, key("chunk", "source"), key("chunk", "target"), F.col("relation")))
    structural = blocks.where(F.col("type").isin("table", "code", "equation", "reference") & (F.col("section_path") != ""))
    piece = key("block", "doc_id", "pos")
    nodes = nodes.unionByName(structural.select(piece.alias("node_id"), F.substring("text", 1, 60).alias("name"), "type", F.array("doc_id").alias("source_doc_ids")))
    edges = edges.unionByName(edge(structural, key("section", "doc_id", "section_path"), piece, F.concat(F.lit("SECTION_HAS_"), F.upper("type"))))
    source = F.when(F.col("source") == "", key("paper", "doc_id")).otherwise(key("method", F.lower("source")))
    kind = F.when(F.col("relation") == "PAPER_HAS_METHOD", "method").when(F.col("relation") == "METHOD_REPORTED_METRIC", "metric").otherwise("dataset")
    edges = edges.unionByName(edge(tested, source, F.xxhash64(kind, F.lower("target")), F.col("relation")))
    merged = nodes.groupBy("node_id", "type").agg(F.min("name").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_doc_ids")))).alias("source_doc_ids"))
    unique = edges.distinct().withColumn("edge_id", F.xxhash64("source", "target", "relation")).withColumn("confidence", F.lit(0.8))
    return Corpus(blocks, chunks, merged, unique)


def route(queries: DataFrame) -> DataFrame:
    """Plans of queries(query_id, text) by the rule router."""
    return routing.rule_plan(queries)


def retrieve(queries: DataFrame, chunks: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None, top_k: int = 8) -> DataFrame:
    """Fused hits of queries over chunks; vectors are (query vectors, chunk vectors with vec_id = chunk_id), if there."""
    plans = route(queries)
    text = chunks.select("chunk_id", F.col("source").alias("title"), "content", "source")
    hit = lambda df, name: df.join(text, "chunk_id").select("query_id", F.lit(name).alias("route"), "rank", F.concat(F.lit("chunk:"), "chunk_id").alias("hit_key"), "title", "content", "source", F.lit("chunk").alias("result_type"))
    hits = hit(lexical.bm25(queries, chunks, top_k), "bm25")
    if vectors is not None:
        hits = hits.unionByName(hit(vector.knn(*vectors, top_k).withColumnRenamed("vec_id", "chunk_id"), "vector"))
    best = fusion.fuse(plans, queries, hits, top_k)
    return best.join(hits.groupBy("query_id", "hit_key").agg(F.any_value("title").alias("title"), F.any_value("content").alias("content")), ["query_id", "hit_key"])


def answer(queries: DataFrame, chunks: DataFrame, top_k: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, grade, verification): hits, how far they carry, and an extractive answer's claims against them."""
    found = retrieve(queries, chunks, top_k=top_k)
    text = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n").alias("context"), F.count("*").cast("int").alias("n_hits"))
    rows = queries.join(text, "query_id", "left").select("query_id", "text", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))
    best = found.where("rank = 1").select("query_id", F.col("content").alias("answer"))
    pieces = found.select("query_id", F.col("hit_key").alias("evidence_id"), F.col("rank").alias("place"), "title", "content")
    return found, evidence.grade(rows), evidence.verify(evidence.claims(best), pieces)


def document_graph(corpus: Corpus, doc_id: int, nodes_most: int = 200) -> tuple[DataFrame, DataFrame]:
    """Nodes of one document and the edges between them, twice as many at most."""
    nodes = corpus.nodes.where(F.array_contains("source_doc_ids", doc_id)).orderBy("type", "node_id").limit(nodes_most)
    return nodes, graph.induced(nodes, corpus.edges).orderBy("edge_id").limit(2 * nodes_most)


def delete_documents(corpus: Corpus, gone: DataFrame) -> Corpus:
    """The corpus without the blocks and chunks of gone(doc_id); nodes and edges stay, as other documents may share them."""
    return corpus._replace(blocks=corpus.blocks.join(gone, "doc_id", "left_anti"), chunks=corpus.chunks.join(gone, "doc_id", "left_anti"))
