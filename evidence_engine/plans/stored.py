"""The indexes that queries search, built once for a session and folder of tables and then read from where they lie."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidence_engine.operators import graph, postings, vector_index
from evidence_engine.operators.embedding import embed
from evidence_engine.sources.scratch import kept, scratch_path
from evidence_engine.sources.tables import chunks, graph_edges, graph_nodes, read

#: Least cells that an approximate search visits for each query.
PROBES = 16
_built: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "chunks", lambda: kept(chunks(spark, sf_dir), "stored-chunks"))


def text_index(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the postings of all chunks."""

    def build() -> str:
        at = scratch_path(spark, "text-index")
        postings.append(stored_chunks(spark, sf_dir), at, buckets=16)
        return at

    return _once(spark, sf_dir, "text", build)


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, embedding of all chunks."""
    return _once(spark, sf_dir, "vectors", lambda: kept(embed(stored_chunks(spark, sf_dir), "chunk_id", "content"), "chunk-vectors"))


def vector_index_of(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the cells of the table of embeddings."""

    def build() -> str:
        at = scratch_path(spark, "vector-index")
        vector_index.build(read(spark, sf_dir, "embeddings"), at)
        return at

    return _once(spark, sf_dir, "embeddings", build)


def probes_of(spark: SparkSession, sf_dir: str) -> int:
    """The cells that an approximate search of the embeddings visits for each query: more where there are more cells."""
    return _once(spark, sf_dir, "probes", lambda: max(PROBES, vector_index.probes_for(read(spark, sf_dir, "embeddings"), vector_index_of(spark, sf_dir))))


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "nodes", lambda: kept(graph_nodes(spark, sf_dir), "stored-nodes"))


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "edges", lambda: kept(graph_edges(spark, sf_dir), "stored-edges"))


def adjacency_of(spark: SparkSession, sf_dir: str) -> graph.Adjacency:
    """The edges laid out by node."""
    return _once(spark, sf_dir, "adjacency", lambda: graph.lay_out(edges_of(spark, sf_dir)))
