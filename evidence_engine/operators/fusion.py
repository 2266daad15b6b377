"""Weighted reciprocal-rank fusion of the routes' hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions import text as tx

# RRF's constant, the routes in their order, trusted sources, words of a semantic question.
RRF_K = 60
ROUTES = ("bm25", "vector", "entity", "graph")
TRUSTED = ("focused_ai_topic", "ai_doc_extraction")
SEMANTIC_WORDS = ("为什么", "如何", "怎么", "原理", "机制", "优势", "区别", "作用", "适合")


def route_weights(plans: DataFrame) -> DataFrame:
    """query_id, w_bm25, w_vector, w_entity, w_graph of plans(query_id, text, intent, graph_method)."""
    text, intent, method = F.col("text"), F.col("intent"), F.col("graph_method")
    exact = text.rlike("[A-Za-z_][A-Za-z0-9_]{3,}|[A-Z]{2,}|[一-龥]{2,6}")
    relation = intent.isin("relation", "path", "subgraph") | method.isin("path", "subgraph")
    semantic = intent.isin("explain", "semantic", "global_summary", "optimize") | tx.contains_any(text, SEMANTIC_WORDS)
    fact = intent.isin("fact", "exact") | exact

    def pick(rel: float, sem: float, fac: float, base: float) -> Column:
        return F.when(relation, rel).when(semantic, sem).when(fact, fac).otherwise(base)

    graph = pick(1.8, 0.45, 0.55, 0.7) + F.when(method.isin("path", "subgraph"), 0.35).otherwise(0.0)
    return plans.select(
        "query_id",
        (pick(0.9, 0.85, 1.55, 1.0) + F.when(exact, 0.25).otherwise(0.0)).alias("w_bm25"),
        pick(0.9, 1.55, 0.95, 1.0).alias("w_vector"),
        pick(0.9, 0.45, 0.9, 0.7).alias("w_entity"),
        F.when(intent == "global_summary", 0.2).otherwise(graph).alias("w_graph"),
    )


def hit_boost(preferred: Column | None = None) -> Column:
    """Boost of a hit row that carries route, title, content, source, result_type, terms, intent and graph_method, and with
    a list of preferred chunk types the chunk_type."""
    title = F.lower(F.coalesce("title", F.lit("")))
    body = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit(""))))
    route, intent, method = F.col("route"), F.col("intent"), F.col("graph_method")
    boost = F.least(F.lit(0.012), tx.hits(F.col("terms"), title) * 0.004)
    boost = boost + F.when(route == "bm25", F.least(F.lit(0.01), tx.hits(F.col("terms"), body) * 0.002)).otherwise(0.0)
    boost = boost + F.when(F.col("source").isin(*TRUSTED), 0.006).otherwise(0.0)
    boost = boost + F.when((route == "graph") & method.isin("path", "subgraph"), 0.004).otherwise(0.0)
    boost = boost - F.when(route.isin("entity", "graph") & intent.isin("explain", "semantic", "global_summary"), 0.004).otherwise(0.0)
    if preferred is not None:
        at = F.array_position(preferred, F.col("chunk_type"))
        liked = F.when(at > 0, 0.03 - F.least(at - 1, F.lit(5)) * 0.003).when(F.col("result_type") == "chunk", -0.004).otherwise(0.0)
        boost = boost + F.when(F.size(preferred) > 0, liked).otherwise(0.0)
    return boost


def _place(col: Column) -> Column:
    return F.array_position(F.array(*(F.lit(r) for r in ROUTES)), col) - 1


def _ranked(rows: DataFrame, score: Column, top_k: int) -> DataFrame:
    """Every occurrence adds up; ties keep the order in which hits were first seen over the routes."""
    total = rows.groupBy("query_id", "hit_key").agg(
        tx.scaled(F.sum(score)).alias("score"), F.min(F.struct(_place(F.col("route")).alias("no"), F.col("rank"))).alias("seen"), F.array_sort(F.collect_list(F.struct(_place(F.col("route")).alias("no"), F.col("route")))).alias("r")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seen"))
    return total.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query_id", "rank", "hit_key", "score", F.array_join(F.transform("r", lambda x: x["route"]), ",").alias("routes"))


def rrf(hits: DataFrame, top_k: int = 10) -> DataFrame:
    return _ranked(hits, 1.0 / (RRF_K + F.col("rank")), top_k).drop("routes")


def fuse(plans: DataFrame, queries: DataFrame, hits: DataFrame, top_k: int = 8, preferred: DataFrame | None = None) -> DataFrame:
    """query_id, rank, hit_key, score (millionths), routes of hits(query_id, route, rank, hit_key, title, ...); with
    preferred(query_id, preferred), hits of these chunk types weigh more."""
    terms = queries.select("query_id", tx.query_terms(F.col("text")).alias("terms"))
    asked = route_weights(plans).join(plans.select("query_id", "intent", "graph_method"), "query_id").join(terms, "query_id")
    liked = None
    if preferred is not None:
        asked = asked.join(preferred, "query_id", "left").withColumn("preferred", F.coalesce("preferred", F.array().cast("array<string>")))
        liked = F.col("preferred")
    weight = F.col("w_graph")
    for route in ROUTES[:-1]:
        weight = F.when(F.col("route") == route, F.col(f"w_{route}")).otherwise(weight)
    return _ranked(hits.join(asked, "query_id"), weight / (RRF_K + F.col("rank")) + hit_boost(liked), top_k)
