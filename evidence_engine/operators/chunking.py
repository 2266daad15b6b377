"""Chunking of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.functions.text import strip

#: Chunk ids are document id times this, plus the chunk's place.
CHUNKS_PER_DOC = 100_000


def fixed_window_chunks(docs: DataFrame, size: int = 1000, overlap: int = 120) -> DataFrame:
    """Windows of `size` characters that overlap by `overlap`, stripped; blank ones go. token_count is characters."""
    step = size - overlap
    n = F.when(F.length("text") <= size, 1).otherwise(F.ceil((F.length("text") - size) / step).cast("int") + 1)
    cut = docs.select("doc_id", "source", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    content = strip(F.substring(F.col("text"), (F.col("chunk_index") * step + 1), F.lit(size)))
    return (
        cut.select((F.col("doc_id") * CHUNKS_PER_DOC + F.col("chunk_index")).alias("chunk_id"), "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), content.alias("content"), "source")
        .where("content <> ''")
        .withColumn("token_count", F.length("content").cast("long"))
    )
