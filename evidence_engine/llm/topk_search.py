"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector is floor(256 * x) of each component, as double. Its components are cut into `parts` fragments; for a query,
each fragment gives one score list over the candidates, and a candidate's score is the sum of its entries. Queries are
packed into passes of bounded size and sent to all tasks; candidates stream past them once a phase and are never
shuffled, so only reports travel.

1. Each task gathers the heads of the score lists of its first tile of candidates (the k largest entries of each
   fragment), sums these candidates up and reports their k best. The k-th best of all reports is a safe cutoff: the
   k-th best score of all is no smaller.
2. The cutoffs travel with the queries. A tile's score lists are computed one fragment at a time, in single precision
   where that is exact. An entry of cutoff / parts or more is collected; a candidate with no such entry in any list stays
   below the cutoff. Where the entries seen plus cutoff / parts for each unseen one stay below it, it goes too.
3. What remains is resolved exactly, in integers. A task keeps the k best of each query and raises its own cutoffs to
   them, so it stops collecting early what can't be among them.

Defined cases: a null vector or id, or a null or non-finite component: the row takes no part; vectors of different
lengths are multiplied over the shorter; ties go to the smaller vec_id; fewer candidates than k: all of them; repeated
candidate rows each count; a repeated query id is answered once, for the least of its vectors; a score beyond a long
saturates; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_engine.llm.common import materialise, pieces, table

K, PARTS = 5, 4
#: Bytes of the queries of one pass (8 a component), candidates of a tile and queries that meet it at once, and results
#: that a task holds before it keeps the best of them only.
PASS_BYTES, TILE, QUERY_TILE, HELD = 16 << 20, 2048, 256, 1 << 20
#: Up to these magnitudes, integers are exact in floats of 4 and 8 bytes.
_EXACT4, _EXACT8 = 2.0**24, 2.0**53
_LOW, _HIGH = -(2**63), 2**63 - 1
SCORES = "query_id long, vec_id long, score long"


class Queries(NamedTuple):
    """Queries of one length: ids, matrix and, where known, cutoffs (_LOW: none)."""

    ids: np.ndarray
    matrix: np.ndarray
    cutoffs: np.ndarray


def _vectors(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the rows that take part, one pair for each length of vector."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1), dtype=np.int64)
    flat = np.asarray(pc.fill_null(vectors.flatten().cast(pa.float64()), np.nan), dtype=np.float64)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    known = np.asarray(pc.is_valid(ids))
    values = np.asarray(pc.fill_null(ids, 0), dtype=np.int64)
    for dim in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero((lengths == dim) & known)
        mat = np.floor(256.0 * flat[starts[rows][:, None] + np.arange(dim)])
        good = np.isfinite(mat).all(axis=1)
        if good.any():
            yield values[rows[good]], mat[good]


def _lists(q: np.ndarray, c: np.ndarray, parts: int) -> list[np.ndarray]:
    """The score lists [query, candidate] of each fragment, exact whatever the magnitudes."""
    dim = min(q.shape[1], c.shape[1])
    cuts = [(e[0], e[-1] + 1) for e in np.array_split(np.arange(dim), parts) if len(e)]
    if not cuts or not len(q) or not len(c):
        return [np.zeros((len(q), len(c)), np.float32)]
    reach = np.abs(q[:, :dim]).max() * np.abs(c[:, :dim]).max() * max(b - a for a, b in cuts)
    if reach < _EXACT4:
        q, c = q.astype(np.float32), c.astype(np.float32)
    elif reach >= _EXACT8:
        whole = np.vectorize(int, otypes=[object])
        q, c = whole(q), whole(c)
    return [q[:, a:b] @ c[:, a:b].T for a, b in cuts]


def _totals(lists: list[np.ndarray], at: tuple[np.ndarray, ...]) -> np.ndarray:
    """Exact scores (long) of some places of the score lists."""
    entries = [x[at] for x in lists]
    if entries[0].dtype == object:
        return np.array([min(max(x, _LOW), _HIGH) for x in sum(entries).ravel().tolist()], np.int64).reshape(entries[0].shape)
    return sum(x.astype(np.int64) for x in entries)


class Best:
    """Results of one task, cut down to the k best of each query now and then."""

    def __init__(self, k: int):
        self.k, self.parts, self.held = k, [], 0

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, vec, score))
        self.held += len(query)

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keeps and returns the k best of each query: score descending, id ascending."""
        q, v, s = (np.concatenate(x) if self.parts else np.zeros(0, np.int64) for x in (list(zip(*self.parts, strict=True)) or [(), (), ()]))
        order = np.lexsort((v, ~s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = rank < self.k
        self.parts = [(q[keep], v[keep], s[keep])]
        self.held = int(keep.sum())
        return self.parts[0]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in self.cut()], names=[x.split()[0] for x in SCORES.split(", ")])


def _heads(q: Queries, ids: np.ndarray, mat: np.ndarray, k: int, parts: int, best: Best) -> None:
    """Phase 1 over one tile: the k largest entries of each fragment, summed up."""
    for s in range(0, len(q.ids), QUERY_TILE):
        q_ids = q.ids[s : s + QUERY_TILE]
        lists = _lists(q.matrix[s : s + QUERY_TILE], mat, parts)
        own = q_ids[:, None] == ids[None, :]
        picks = []
        for x in lists:
            x = np.where(own, _lowest(x), x)
            picks.append(np.argpartition(x, -k, axis=1)[:, -k:] if len(ids) > k else np.broadcast_to(np.arange(len(ids)), x.shape))
        pick = np.sort(np.concatenate(picks, axis=1), axis=1)
        once = np.c_[np.ones(len(pick), bool), pick[:, 1:] != pick[:, :-1]]
        rows, at = np.nonzero(once & ~np.take_along_axis(own, pick, axis=1))
        col = pick[rows, at]
        best.add(q_ids[rows], ids[col], _totals(lists, (rows, col)))


def _lowest(x: np.ndarray):
    return x.min() - 1 if x.size else 0


def _collect(q: Queries, ids: np.ndarray, mat: np.ndarray, parts: int, best: Best) -> None:
    """Phases 2 and 3 over one tile."""
    for s in range(0, len(q.ids), QUERY_TILE):
        q_ids, cut = q.ids[s : s + QUERY_TILE], q.cutoffs[s : s + QUERY_TILE]
        lists = _lists(q.matrix[s : s + QUERY_TILE], mat, parts)
        known = cut > _LOW
        # A little less than the share of the cutoff, so rounding leaves nothing out.
        share = np.where(known, cut / len(lists), -np.inf)
        share = np.where(known, share - 1e-6 * np.abs(share) - 1e-6, share)[:, None]
        if lists[0].dtype == object:
            row, col = np.nonzero(np.ones(lists[0].shape, bool))
        else:
            least = share.astype(lists[0].dtype)
            least = np.where(np.isfinite(least), np.nextafter(least, -np.inf, dtype=least.dtype), least)
            seen = lists[0] >= least
            for x in lists[1:]:
                seen |= x >= least
            row, col = np.nonzero(seen)
            reach = sum(np.maximum(x[row, col], share[row, 0]) for x in lists)
            near = ~known[row] | (reach >= cut[row] - 1e-6 * np.abs(cut[row].astype(np.float64)) - 1e-5)
            row, col = row[near], col[near]
        total = _totals(lists, (row, col))
        good = (total >= cut[row]) & (q_ids[row] != ids[col])
        row, col = row[good], col[good]
        best.add(q_ids[row], ids[col], total[good])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, mat in _vectors(batch.column(0), batch.column(1)):
            for s in range(0, len(ids), TILE):
                yield ids[s : s + TILE], mat[s : s + TILE]


def _head_side(sent: Broadcast, k: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, first = Best(k), True
        for ids, mat in _tiles(batches):
            if first:
                for q in sent.value:
                    _heads(q, ids, mat, k, parts, best)
            first = False
        yield best.batch()

    return run


def _collect_side(sent: Broadcast, k: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, queries = Best(k), [q._replace(cutoffs=q.cutoffs.copy()) for q in sent.value]
        most = max(HELD, 4 * k * sum(len(q.ids) for q in queries))
        for ids, mat in _tiles(batches):
            for q in queries:
                _collect(q, ids, mat, parts, best)
            if best.held > most:
                by, _, score = best.cut()
                _raise(queries, by, score, k)
        yield best.batch()

    return run


def _raise(queries: list[Queries], by: np.ndarray, score: np.ndarray, k: int) -> None:
    """Cutoffs that the results so far allow: the k-th best score of each query, of which there are k or fewer here."""
    last = np.flatnonzero(np.r_[by[1:] != by[:-1], True]) if len(by) else np.zeros(0, np.int64)
    full = last[np.diff(np.r_[-1, last]) == k]
    for q in queries:
        order = np.argsort(q.ids)
        at = np.searchsorted(q.ids, by[full], sorter=order)
        here = (at < len(order)) & (q.ids[order[np.minimum(at, len(order) - 1)]] == by[full])
        np.maximum.at(q.cutoffs, order[at[here]], score[full][here])


def _ranked(scores: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(w))


def top_k(spark: SparkSession, queries: DataFrame, candidates: DataFrame, k: int = K, parts: int = PARTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates (vec_id, embedding) of each query (vec_id, embedding).

    Queries go in passes of about PASS_BYTES, drawn by a hash of their ids; only one pass is on the driver at a time.
    """
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    asked = queries.select(F.col("vec_id").cast("long"), "embedding").where(usable).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = materialise(spark, asked, "topk-queries")
    pool = candidates.select(F.col("vec_id").cast("long"), "embedding").where(usable)
    size = asked.agg(F.sum(16 + 8 * F.size("embedding"))).first()[0] or 0
    n = pieces(size, PASS_BYTES, least=1)
    out = None
    for p in range(n):
        found = _one_pass(spark, asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == p), pool, k, parts)
        found = found if n == 1 else materialise(spark, found, "topk-pass")
        out = found if out is None else out.unionByName(found)
    return out


def _one_pass(spark: SparkSession, asked: DataFrame, pool: DataFrame, k: int, parts: int) -> DataFrame:
    rows = asked.toArrow().combine_chunks()
    groups = []
    if rows.num_rows:
        for ids, mat in _vectors(rows.column(0).combine_chunks(), rows.column(1).combine_chunks()):
            groups.append(Queries(ids, mat, np.full(len(ids), _LOW, np.int64)))
    sent = spark.sparkContext.broadcast(groups)
    heads = _ranked(pool.mapInArrow(_head_side(sent, k, parts), SCORES)).where(F.col("rank") == k).select("query_id", "score").toArrow()
    known = dict(zip(heads.column(0).to_pylist(), heads.column(1).to_pylist(), strict=True))
    sent.unpersist()
    # A saturated score says nothing about the sum below it.
    cut = lambda i: c if (c := known.get(i, _LOW)) < _HIGH else _LOW
    groups = [q._replace(cutoffs=np.array([cut(i) for i in q.ids.tolist()], np.int64)) for q in groups]
    sent = spark.sparkContext.broadcast(groups)
    best = _ranked(pool.mapInArrow(_collect_side(sent, k, parts), SCORES)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings")
    return top_k(spark, vecs.where(F.col("vec_id") % 50 == 0), vecs)
