"""Texts as vectors: a deterministic hashing embedder, and the query templates that are found by it.

A token adds +1 or -1 to one of DIM places, both drawn from its MD5, so every engine gets the same whole numbers. Any
other embedder can stand in: the operators take vectors as columns.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.functions import text as tx
from evidence_engine.operators import vector

DIM = 64


def _places(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    heads = [hashlib.md5(w.encode()).hexdigest()[:3] for w in words]
    return np.array([int(h[:2], 16) % DIM for h in heads], np.int64), np.array([1.0 if int(h[2], 16) < 8 else -1.0 for h in heads])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        n = len(lists)
        coded = pc.dictionary_encode(lists.flatten())
        slot, sign = _places(coded.dictionary.to_pylist())
        codes = np.asarray(coded.indices)
        row = np.repeat(np.arange(n), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        mat = np.bincount(row * DIM + slot[codes], sign[codes], n * DIM).astype(np.float32) if len(codes) else np.zeros(n * DIM, np.float32)
        out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * DIM, pa.int32()), pa.array(mat))
        yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["id", "embedding"])


def embed(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id_col, embedding (array<float> of DIM places) of each row; a text without a token is all zeros."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), tx.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    return own.mapInArrow(_vectors, "id long, embedding array<float>").withColumnRenamed("id", id_col)


# The built-in query templates as name, intent, patterns, rewriting and graph method.
TEMPLATES = (
    ("事实解释模板", "fact", ("X 是什么？", "介绍一下 X", "X 的定义是什么？"), "解释 {entity} 的定义、作用和相关证据。", "ego"),
    ("原理说明模板", "explain", ("X 为什么这样设计？", "X 的原理是什么？", "X 的机制是什么？"), "说明 {entity} 的工作原理、设计原因和关键机制。", "ego"),
    ("关系分析模板", "relation", ("A 和 B 有什么关系？", "A 怎么影响 B？", "A 和 B 怎么配合？"), "分析 {entity_a} 与 {entity_b} 的关系、连接路径、共同上下文和证据来源。", "path"),
    ("路径推理模板", "path", ("A 如何导致 B？", "A 到 B 的链路是什么？", "为什么 A 会影响 B？"), "查找 {entity_a} 到 {entity_b} 的多跳路径、因果链路和中间节点。", "path"),
    ("子图梳理模板", "subgraph", ("围绕 X 有哪些模块？", "X 的上下游有哪些？", "梳理 X 的局部结构。"), "围绕 {topic} 梳理相关节点、上下游关系和局部结构。", "subgraph"),
    ("全局总结模板", "global_summary", ("整体架构是什么？", "主要主题有哪些？", "全局总结一下。"), "总结知识库或系统的整体主题、模块分类和高层结构。", "none"),
    ("对比分析模板", "compare", ("A 和 B 有什么区别？", "A 和 B 对比一下", "A 相比 B 的优缺点是什么？"), "对比 {entity_a} 与 {entity_b} 的定义、使用场景、优缺点和关系。", "path"),
    ("优化建议模板", "optimize", ("X 怎么优化？", "X 哪里不合理？", "如何改进 X？"), "分析 {topic} 的现状、问题、优化方向和可执行改进步骤。", "subgraph"),
)
TEMPLATE_SOURCE = "query_template"


def template_text(name: str, intent: str, patterns: tuple[str, ...], rewrite: str, method: str) -> str:
    """A template as the JSON text that is stored and embedded."""
    plan = {"bm25": True, "vector": True, "graph": method != "none", "graph_method": method}
    return json.dumps({"name": name, "intent": intent, "patterns": list(patterns), "rewrite_template": rewrite, "retrieval_plan": plan}, ensure_ascii=False, indent=2)


def templates(spark: SparkSession) -> DataFrame:
    """title, content, source, intent of the built-in templates."""
    return spark.createDataFrame([(t[0], template_text(*t), TEMPLATE_SOURCE, t[1]) for t in TEMPLATES], "title string, content string, source string, intent string")


def seed_templates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The built-in templates that docs(title, source) don't hold yet, by source and title."""
    return templates(spark).join(docs.select("source", "title"), ["source", "title"], "left_anti")


def similar_templates(queries: DataFrame, stored: DataFrame, top_k: int = 3) -> DataFrame:
    """query_id, rank, title, intent, score of the stored templates(template_id, title, content, intent) next to a query."""
    near = vector.knn(embed(queries, "query_id"), embed(stored, "template_id", "content").withColumnRenamed("template_id", "vec_id"), top_k)
    return near.withColumnRenamed("vec_id", "template_id").join(stored.select("template_id", "title", "intent"), "template_id").select("query_id", "rank", "title", "intent", "score")
