"""Tables of steps in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir.

    Only a local session that names none (tests) gets a temporary folder of this machine; on a cluster the executors
    would each write to their own disk, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='evidence-engine-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back."""
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def kept(df: DataFrame, tag: str) -> DataFrame:
    """A small table of a step that several later steps read, materialised."""
    return materialise(df.sparkSession, df, tag)


def parts_for(df: DataFrame, each: int) -> int:
    """How many partitions of about `each` bytes of df's input files a shuffle of it needs, one for every core at least.

    The sizes of the files that the plan reads are added up, as Spark's estimate of a join is a product; what comes from
    elsewhere than files counts nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(n for n in sizes if n < 1 << 60) // each))


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables from materialise that nothing reads any more."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
