"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.sources.tables import spread

#: Spark's size of a plan that it knows nothing of is the greatest long.
_NO_ESTIMATE = 1 << 60
#: Texts are handled in slices of about this many bytes, so a Python worker's memory doesn't follow the Arrow batch.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark, spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that driver and executors share.

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


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables from materialise that nothing reads any more."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now, not at its next half-hourly collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of texts that a task holds at a time, in Arrow and in the Parquet reader: Spark's own number, and this one.
TEXT_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": (10_000, 1_000), "spark.sql.parquet.columnarReaderBatchSize": (4_096, 512)}


def few_texts_at_once(spark: SparkSession) -> None:
    """Let tasks hold TEXT_ROWS rows at a time from here on: 10,000 whole texts are a task's whole file, and an executor has
    them in Arrow's memory, beside its heap, and in its Python workers at once.

    It is set for the session, as plans are made when their callers run them; numbers other than Spark's own stay.
    """
    for key, (usual, few) in TEXT_ROWS.items():
        if int(spark.conf.get(key)) == usual:
            spark.conf.set(key, few)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size; for a file scan, the files' bytes, and no row is read.

    Where there is no estimate (rows that came from elsewhere than a file), the bytes of its strings are summed up.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < _NO_ESTIMATE:
        return size
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    return int(df.agg(F.sum(sum(strings, F.lit(8)))).first()[0] or 0)


def pieces(df_bytes: int, each: int, least: int = 16) -> int:
    """How many buckets of about `each` bytes; it follows the input, so no bucket grows with it."""
    return int(max(least, -(-df_bytes // each)))


def tasks_for(spark: SparkSession, df_bytes: int, each: int = 32 << 20) -> int:
    """How many tasks a shuffle of an input of so many bytes needs; it follows the input, the setting is the least."""
    return pieces(df_bytes, each, least=int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) row ranges of a batch, each of about `limit` bytes of text, one row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    yield start, len(col)


def texts_of(batch: pa.RecordBatch, start: int, end: int, column: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of rows start..end-1."""
    col = batch.column(batch.schema.get_field_index(column)).slice(start, end - start)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return col.cast(kind).to_pylist()


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def cut_at_space(text: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """The text in pieces of about `most` bytes, cut at white space, so the words of the pieces are the text's words."""
    at = 0
    while len(text) - at > most:
        m = _SPACE.search(text, at + most)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for up to `most` words."""

    def __init__(self, seed: int = 0, most: int = 500_000):
        import xxhash

        super().__init__()
        self.hash, self.seed, self.most = xxhash.xxh3_64_intdigest, seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.hash(word, self.seed)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
