"""Texts are dealt out by the bytes of their files, so a partition's lines don't grow with the tables."""

from pyspark.sql import functions as F

from evidence_engine.operators import segments
from evidence_engine.sources.scratch import parts_for


def test_partitions_of_texts_follow_the_files(spark, tmp_path, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("# A\nx "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    docs.write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    joined = docs.join(docs.select("doc_id", F.col("text").alias("other")), "doc_id")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert parts_for(docs, size // 20) in (20, 21) and parts_for(joined, size // 20) in (40, 41, 42)
    assert parts_for(docs, 1 << 40) == spark.sparkContext.defaultParallelism
    assert parts_for(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 1) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(segments, "PART_BYTES", size // 20)
    assert segments.lines_of(docs, "text").rdd.getNumPartitions() in (20, 21)
    assert segments.markdown_blocks(docs, "text").count() == 6000
