"""From raw documents to packed training sequences: five stages, each on all that the one before it kept.

language_id drops documents whose language can't be told; near_dedup keeps one document of each group of near copies;
decontaminate drops documents that hold benchmark passages; secret_scan cuts secrets out of the texts; packing returns
pieces in sequences. All but the last return the columns of documents. Stages hold few texts at a time, see
common.few_texts_at_once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm import decontaminate, language_id, packing, secret_scan, simhash
from evidence_engine.llm.common import few_texts_at_once, materialise, table


def language_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language can be told, by a field trained on a bounded sample of their own labelled rows.

    Defined cases: null texts and texts without a letter go; without labelled rows nothing can be told, so all rows go;
    repeated rows stay or go together; an empty table stays empty; other columns are passed on, whatever their names.
    """
    few_texts_at_once(spark)
    return language_id.keep_identified(spark, docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of near copies, see simhash.drop_near_copies for its defined cases."""
    few_texts_at_once(spark)
    return simhash.drop_near_copies(spark, docs).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold items of the benchmark, see decontaminate.drop_contaminated for its defined cases."""
    few_texts_at_once(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets cut out of their texts, see secret_scan.cut_secrets for its defined cases; n_chars, where there is
    such a column, is the cut text's length."""
    few_texts_at_once(spark)
    cleaned = secret_scan.cut_secrets(spark, docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cleaned


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in sequences, see packing for its defined cases."""
    few_texts_at_once(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]
#: No SQL for the field's inference, the trie join's fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(spark, docs, f"stage-{name}")
    return docs
