"""Nearest neighbours by cosine distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.sources.scratch import kept

#: Bytes of query vectors that travel to the tasks at once, and vectors that meet them at once.
PASS_BYTES, TILE = 16 << 20, 1024
_FOUND = "query_id long, vec_id long, score long"


def _units(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of the rows that have a direction, one pair for each length of vector."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), dtype=np.int64)
    flat = np.asarray(pc.fill_null(vectors.flatten().cast(pa.float64()), np.nan), dtype=np.float64)
    starts = np.cumsum(lengths) - lengths
    values = np.asarray(pc.fill_null(ids, 0), dtype=np.int64)
    known = np.asarray(pc.is_valid(ids))
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero((lengths == dim) & known)
        mat = flat[starts[rows][:, None] + np.arange(dim)]
        norm = np.sqrt((mat * mat).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        if good.any():
            yield values[rows[good]], mat[good] / norm[good, None]


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    keep = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)])) < top_k
    return query[keep], vec[keep], score[keep]


def _nearer(held: tuple, ids: np.ndarray, mat: np.ndarray, q_ids: np.ndarray, q_mat: np.ndarray, top_k: int) -> tuple:
    """The top_k of each query among those held and the vectors of mat."""
    for s in range(0, len(ids), TILE):
        cosine = mat[s : s + TILE] @ q_mat.T
        score = np.floor(np.maximum(0.0, 1 - (1 - cosine) / 2) * 1e6 + 0.5).astype(np.int64)
        # Only what may be among a query's best goes on.
        least = np.partition(score, -top_k, axis=0)[-top_k] if len(score) > top_k else np.full(len(q_ids), -1)
        row, col = np.nonzero(score >= least)
        held = _best(*(np.concatenate(x) for x in zip(held, (q_ids[col], ids[s + row], score[row, col]), strict=True)), top_k)
    return held


def _groups(rows: pa.Table | pa.RecordBatch, names: pa.Array | None) -> Iterator[tuple[int, pa.Table | pa.RecordBatch]]:
    """(number, rows) of each of the named groups (column 2) that has rows; all rows are one group where there are no names."""
    if names is None:
        yield 0, rows
        return
    number = np.asarray(pc.fill_null(pc.index_in(rows.column(2), value_set=names), -1))
    order = np.argsort(number, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
        if len(at) and number[at[0]] >= 0:
            yield int(number[at[0]]), rows.take(pa.array(at))


def _meet(sent: Broadcast, top_k: int):
    """Each task's top_k of each query over the vectors of its group that stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64),) * 3
        held, (names, asked) = {}, sent.value
        for batch in batches:
            for g, rows in _groups(batch, names):
                for ids, mat in _units(rows.column(0), rows.column(1)):
                    for q_ids, q_mat in asked.get(g, ()):
                        if q_mat.shape[1] == mat.shape[1]:
                            key = (g, mat.shape[1])
                            held[key] = _nearer(held.get(key, none), ids, mat, q_ids, q_mat, top_k)
        best = [np.concatenate(x) for x in zip(none, *held.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["query_id", "vec_id", "score"])

    return run


def _nearest(asked: DataFrame, pool: DataFrame, top_k: int) -> DataFrame:
    """query_id, rank, vec_id, score of asked(query_id, embedding) among pool(vec_id, embedding); where both have a column g,
    only vectors of the query's own g meet it."""
    context, grouped = asked.sparkSession.sparkContext, "g" in asked.columns
    size = asked.agg(F.sum(16 + 8 * F.size("embedding"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    found = None
    for k in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k).toArrow().combine_chunks()
        names = pc.unique(rows.column("g")) if grouped and rows.num_rows else None
        units = {g: list(_units(r.column(0).combine_chunks(), r.column(1).combine_chunks())) for g, r in _groups(rows, names)} if rows.num_rows else {}
        part = pool.mapInArrow(_meet(context.broadcast((names, units)), top_k), _FOUND)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query_id", "rank", "vec_id", "score")


def knn(queries: DataFrame, vectors: DataFrame, top_k: int = 10, where: Column | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (millionths of max(0, 1 - d/2), d the cosine distance) of the nearest vectors.

    queries(query_id, embedding) are a stated set: they go to the tasks in passes of about PASS_BYTES, drawn by a hash of
    their ids, and the vectors that pass the filter stream past them; only each task's bests are shuffled. Vectors
    without a direction, and those of another length than the query's, take no part.
    """
    asked = queries.select(F.col("query_id").cast("long"), "embedding").where("embedding is not null")
    pool = (vectors if where is None else vectors.where(where)).select(F.col("vec_id").cast("long"), "embedding")
    return _nearest(asked, pool, top_k)


def _or_all(near: DataFrame, queries: DataFrame, vectors: DataFrame, top_k: int) -> DataFrame:
    """near, and knn of the queries that got nothing there; filtered tells which."""
    near = kept(near, "near")  # both the rest and the result read it
    rest = kept(queries.join(near.select("query_id").distinct(), "query_id", "left_anti"), "near-rest")
    return near.withColumn("filtered", F.lit(True)).unionByName(knn(rest, vectors, top_k).withColumn("filtered", F.lit(False)))


def knn_with_fallback(queries: DataFrame, vectors: DataFrame, top_k: int, where: Column) -> DataFrame:
    """knn under the filter; a query that gets nothing under it is asked again without."""
    return _or_all(knn(queries, vectors, top_k, where), queries, vectors, top_k)


def knn_by_group(queries: DataFrame, vectors: DataFrame, top_k: int, group: str) -> DataFrame:
    """knn among the vectors of the query's own group, and a query whose group holds none asks all; filtered tells which.

    queries(query_id, embedding, <group>) go to the tasks by their groups, and vectors stream past those of their own.
    """
    kind = queries.select(group).union(vectors.select(group)).schema[0].dataType
    own = F.col(group).cast(kind).alias("g")
    asked = queries.select(F.col("query_id").cast("long"), "embedding", own).where("embedding is not null and g is not null")
    return _or_all(_nearest(asked, vectors.select(F.col("vec_id").cast("long"), "embedding", own), top_k), queries, vectors, top_k)


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "vec_id") -> DataFrame:
    """stored with fresh rows put in by key: a row of the same key is replaced, of fresh ones with one key the last (by
    seq) stays."""
    last = fresh.groupBy(key).agg(F.max_by(F.struct(*(c for c in fresh.columns if c not in (key, "seq"))), "seq").alias("row")).select(key, "row.*")
    return stored.join(last.select(key), key, "left_anti").unionByName(last.select(*stored.columns))
