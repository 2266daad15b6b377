"""A stored inverted-file index over vectors: k-means cells, 8-bit residual codes, bounds, and exact re-ranking.

Vectors count by direction. Cells are fitted on a bounded sample and take in every vector; the table lies in folders by
cell, a row with its vector and its code: what is left after the cell's centre is taken away, in steps of a 127th of its
greatest component, and how far the code is off (`err`). For a query, a vector's cosine lies within `err` of its code's, and
no vector of a cell is nearer in angle than the centre is, less the cell's greatest angle to it.

A search first visits the `probes` cells nearest to each query. Codes give each query's candidates: a vector stays if its
code's cosine plus `err` reaches the k-th best cosine less `err` seen; these few are read again and ranked by their own
components. With `probes` alone the result is approximate. Otherwise a second round visits each cell whose bound reaches
the k-th best score so far, which makes the result that of an exhaustive search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_engine.operators.lexical import few
from evidence_engine.operators.vector import _best, _units, knn
from evidence_engine.sources.scratch import kept

#: Vectors that cells are fitted on, rounds of fitting, most cells, and bytes of queries that travel to the tasks at once.
SAMPLE, ROUNDS, CELLS_MOST, PASS_BYTES = 20_000, 12, 4096, 8 << 20
#: Vectors whose neighbours tell how many cells a search must visit, and what part of these it is to find: more than the 0.9
#: that is asked for, as other queries differ.
TRIED, AIM = 512, 0.95
_ROWS = "vec_id bigint, cell int, code binary, step float, err float, embedding array<double>"
_FOUND = "query_id bigint, vec_id bigint, cell int, least bigint, most bigint"
_MILLION = 1e6


def fit_cells(unit: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centres of about even cells, by rounds of assignment and mean; an empty cell starts again at the vector that
    fits worst."""
    rs = np.random.RandomState(seed)
    centres = unit[rs.permutation(len(unit))[:cells]].copy()
    for _ in range(ROUNDS):
        near = unit @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        worst = near.max(axis=1).argsort()
        norm = np.sqrt((sums * sums).sum(axis=1))
        empty = np.flatnonzero(norm == 0)
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
        centres[empty] = unit[worst[: len(empty)]]
    return centres


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = centres.shape[1]
        for batch in batches:
            for ids, unit in _units(batch.column(0), batch.column(1)):
                if unit.shape[1] != dim:
                    continue
                cell = (unit @ centres.T).argmax(axis=1)
                rest = unit - centres[cell]
                step = np.maximum(np.abs(rest).max(axis=1) / 127, 1e-12).astype(np.float32)
                code = np.rint(rest / step[:, None]).clip(-127, 127).astype(np.int8)
                off = rest - code * step[:, None].astype(np.float64)
                # A little more than the distance, for what rounding takes away.
                err = (np.sqrt((off * off).sum(axis=1)) * (1 + 1e-6) + 1e-9).astype(np.float32)
                raw = np.ascontiguousarray(code).tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), pa.array(cell.astype(np.int32)), pa.array([raw[k * dim : (k + 1) * dim] for k in range(len(ids))], pa.binary()), pa.array(step), pa.array(np.nextafter(err, np.float32(np.inf))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * dim, pa.int32()), pa.array(unit.ravel())),
                ], names=[x.split()[0] for x in _ROWS.split(", ")])

    return run


def build(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """The index of vectors(vec_id, embedding) in the folder path; cells are about the root of the vectors' number.

    Vectors without a direction, and those of another length than most of the sample, are left out.
    """
    pool = vectors.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null and embedding is not null")
    n = pool.count()
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = pool.where(place < SAMPLE / max(1, n)).toArrow().combine_chunks()
    parts = [unit for _, unit in _units(rows.column(0).combine_chunks(), rows.column(1).combine_chunks())] if rows.num_rows else []
    unit = max(parts, key=len) if parts else np.zeros((1, 1))
    k = max(1, min(cells or int(np.sqrt(n)), CELLS_MOST, len(unit)))
    centres = fit_cells(unit, k)
    # A cell's rows go to several tasks, so no cell is one task's.
    stored = pool.mapInArrow(_assigned(centres), _ROWS).repartition("cell", F.pmod("vec_id", F.lit(4)))
    stored.write.partitionBy("cell").parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centres)], "cell int, centre array<double>")
    kept_rows = spark.read.schema(_ROWS).parquet(f"{path}/vectors").select("cell", "embedding").join(F.broadcast(c), "cell")
    cosine = F.aggregate(F.zip_with("embedding", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sizes = kept_rows.groupBy("cell").agg(F.count("*").alias("n"), F.min(cosine).alias("least"))
    c.join(sizes, "cell").coalesce(1).write.parquet(f"{path}/cells")


def probes_for(vectors: DataFrame, path: str, top_k: int = 10) -> int:
    """How many of its nearest cells a query must visit to find AIM of its neighbours, by those of about TRIED vectors: an
    exact search for them over all vectors, and the cells that its hits lie in."""
    spark = vectors.sparkSession
    cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)  # at most CELLS_MOST
    pool = vectors.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null and embedding is not null")
    place = F.pmod(F.xxhash64("vec_id", F.lit("tried")), F.lit(1 << 30)) / float(1 << 30)
    some = kept(pool.where(place < TRIED / max(1, pool.count())).select(F.col("vec_id").alias("query_id"), "embedding"), "vector-tried")
    near = kept(knn(some, pool, top_k), "vector-near")
    rows = spark.read.schema(_ROWS).parquet(f"{path}/vectors").select("vec_id", "cell", F.col("embedding").alias("unit"))
    own = rows.join(some.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "unit")
    hits = near.join(rows.select("vec_id", "cell"), "vec_id").select("query_id", "cell").join(own, "query_id").collect()  # about TRIED * top_k
    if not hits:
        return len(cells)
    number = {r.cell: k for k, r in enumerate(cells)}
    cosine = np.array([h.unit for h in hits]) @ np.array([r.centre for r in cells]).T
    mine = cosine[np.arange(len(hits)), [number[h.cell] for h in hits]]
    # How many cells are nearer than the one that the neighbour lies in.
    before = np.sort((cosine > mine[:, None]).sum(axis=1))
    return int(before[min(len(before) - 1, int(np.ceil(AIM * len(before))) - 1)]) + 1


def _visit(sent: Broadcast, top_k: int):
    """Candidates of each query among the cells that it probes: bounds of their scores by their codes, in millionths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units, centres, probes = sent.value
        low = np.full(len(ids), -1, np.int64)
        held = [np.zeros(0, np.int64)] * 3
        out = []
        for batch in batches:
            cell = np.asarray(batch.column(0), dtype=np.int64)
            vec = np.asarray(batch.column(1), dtype=np.int64)
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(len(vec), -1)
            step, err = (np.asarray(batch.column(j), dtype=np.float64) for j in (3, 4))
            for c in np.unique(cell).tolist():
                asked = probes.get(c)
                if asked is None:
                    continue
                rows = np.flatnonzero(cell == c)
                cosine = (units[asked] @ centres[c])[None, :] + (code[rows].astype(np.float64) @ units[asked].T) * step[rows, None]
                score = lambda x: np.floor(np.maximum(0.0, 0.5 + np.minimum(x, 1.0) / 2) * _MILLION + 0.5).astype(np.int64)
                least, most = score(cosine - err[rows, None]) - 1, score(cosine + err[rows, None]) + 1
                row, col = np.nonzero(most >= low[asked])
                q = asked[col]
                held = _best(*(np.concatenate(x) for x in zip(held, (q, vec[rows[row]], least[row, col]), strict=True)), top_k)
                full = np.bincount(held[0], minlength=len(ids)) == top_k
                last = np.full(len(ids), -1, np.int64)
                np.minimum.at(floor := np.full(len(ids), np.iinfo(np.int64).max), held[0], held[2])
                last[full] = floor[full]
                low = np.maximum(low, last)
                out.append((q, vec[rows[row]], np.full(len(row), c), least[row, col], most[row, col]))
            if sum(len(x[0]) for x in out) > 200_000:
                out = [_above(out, low)]
        q, v, c, least, most = _above(out, low)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(v), pa.array(c.astype(np.int32)), pa.array(least), pa.array(most)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def _above(out: list, low: np.ndarray) -> tuple:
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
    keep = cols[4] >= low[cols[0]]
    return tuple(x[keep] for x in cols)


def _round(spark: SparkSession, path: str, ids: np.ndarray, units: np.ndarray, centres: np.ndarray, probed: np.ndarray, top_k: int) -> DataFrame:
    """query_id, vec_id, score of the candidates in the cells that queries probe (probed[query, cell])."""
    probes = {c: np.flatnonzero(probed[:, c]) for c in np.flatnonzero(probed.any(axis=0)).tolist()}
    sent = spark.sparkContext.broadcast((ids, units, centres, probes))
    table = spark.read.schema(_ROWS).parquet(f"{path}/vectors").where(F.col("cell").isin(list(probes)))
    found = table.select("cell", "vec_id", "code", "step", "err").mapInArrow(_visit(sent, top_k), _FOUND)
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("least"), "vec_id"))
    found = kept(found, "vector-candidates")
    cut = found.withColumn("r", r).where(F.col("r") == top_k).select("query_id", F.col("least").alias("cut"))
    found = found.join(cut, "query_id", "left").where("cut is null or most >= cut").select("query_id", "vec_id", "cell")
    rows = spark.createDataFrame([(int(i), u.tolist()) for i, u in zip(ids, units, strict=True)], "query_id bigint, q array<double>")
    # What is left of each query is a few vectors; only their rows are read again, of the cells that were visited.
    again = table.select("cell", "vec_id", "embedding").join(F.broadcast(found) if few(found) else found, ["cell", "vec_id"]).join(F.broadcast(rows), "query_id")
    cosine = F.aggregate(F.zip_with("embedding", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return again.select("query_id", "vec_id", F.floor(F.greatest(F.lit(0.0), 1 - (1 - cosine) / 2) * 1e6 + 0.5).cast("long").alias("score"))


def _ranked(found: DataFrame, top_k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query_id", "rank", "vec_id", "score")


def search(queries: DataFrame, path: str, top_k: int = 10, probes: int = 8, exact: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score (millionths, as vector.knn) of queries(query_id, embedding), a stated set.

    Queries go in passes of about PASS_BYTES, drawn by a hash of their ids.
    """
    spark = queries.sparkSession
    cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)  # at most CELLS_MOST
    if not cells:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    centres = np.zeros((cells[-1].cell + 1, len(cells[0].centre)))
    angle = np.full(len(centres), -1.0)
    for r in cells:
        centres[r.cell] = r.centre
        angle[r.cell] = np.arccos(np.clip(r.least - 1e-9, -1, 1))
    known = angle >= 0
    asked = queries.select(F.col("query_id").cast("long"), "embedding").where("query_id is not null and embedding is not null")
    size = asked.agg(F.sum(16 + 8 * F.size("embedding"))).first()[0] or 0
    passes, out = max(1, -(-size // PASS_BYTES)), None
    for p in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).toArrow().combine_chunks()
        groups = list(_units(rows.column(0).combine_chunks(), rows.column(1).combine_chunks())) if rows.num_rows else []
        for ids, units in groups:
            if units.shape[1] != centres.shape[1]:
                continue
            near = np.where(known[None, :], units @ centres.T, -2.0)
            order = np.argsort(-near, axis=1)[:, :probes]
            probed = np.zeros(near.shape, bool)
            np.put_along_axis(probed, order, True, axis=1)
            probed &= known[None, :]
            found = kept(_ranked(_round(spark, path, ids, units, centres, probed, top_k), top_k), "vector-hits")
            if exact:
                worst = {r.query_id: r.score for r in found.where(F.col("rank") == top_k).collect()}  # one row a query of the pass
                low = np.array([worst.get(int(i), -1) for i in ids])
                # The greatest cosine that a vector of a cell can have with a query.
                reach = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - angle[None, :] - 1e-7))
                more = (np.floor((0.5 + reach / 2) * _MILLION + 0.5) + 1 >= low[:, None]) & ~probed & known[None, :]
                if more.any():
                    found = _ranked(found.drop("rank").unionByName(_round(spark, path, ids, units, centres, more, top_k)), top_k)
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint") if out is None else out
