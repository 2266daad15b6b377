"""What the pipeline's stages hold of texts at a time."""

import pyarrow as pa
import pytest

import corpus_pipeline
from evidence_engine.llm.common import TEXT_ROWS


@pytest.fixture
def usual(spark):
    before = {key: spark.conf.get(key) for key in TEXT_ROWS}
    for key, (own, _) in TEXT_ROWS.items():
        spark.conf.set(key, own)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_hold_few_texts_at_a_time(spark, sf, usual, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    dict(corpus_pipeline.STAGES)[name](spark, docs, sf)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    got = [r.n for r in spark.range(2500).coalesce(1).mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 2500
    assert max(got) <= 1000
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def test_a_callers_own_number_stays(spark, sf, usual):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 77)
    corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "77"
