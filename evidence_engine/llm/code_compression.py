"""Vector code compression: product codebooks fitted by rounds of assignment, nearest entries by a vantage-point tree.

A vector is floor(1024 * x) of each component, cut into PARTS equal consecutive parts. Each part position's codebook starts
as that part of the ENTRIES smallest ids; each round assigns every part to its nearest entry (ties: the lower index) and
replaces an entry by the floor of its parts' mean. A round is one scan of the vectors with the codebooks, of fixed size,
sent along; tasks return sums by entry, so nothing that grows with the rows reaches the driver.

Nearest entries come from a vantage-point tree over each position's entries. A node's vantage entry splits the others by
their distance to it; a child keeps the least and greatest of these distances, rounded outwards. Parts of a tile first go
down to one leaf each, for a near entry to begin with; then they go through the tree together, and a child is left out only
for parts whose bound is greater than their best so far (not where it is equal). Distances to entries are compared as exact
integers, with the lower index winning ties, so bounds in floating point decide nothing but which entries are looked at.

Defined cases: null vectors, and vectors with null or non-finite components, take no part; neither do vectors of another
length than the first one by id; a length that isn't a multiple of PARTS is cut at floor(k * length / PARTS); null ids come
last; repeated ids keep a row each, ordered by their components; fewer rows than ENTRIES: that many entries; components
whose squares leave the exact range of floats are handled as Python integers; an error beyond a long saturates; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm.common import materialise, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf, vectors that go through a tree together, and copies of a label's sum, so no label is one task's.
LEAF, TILE, SALTS = 8, 4096, 8
_EXACT = 2.0**53
#: Sums travel in limbs of this many bits, of which ordinary data need one.
_LIMB = 60
_HIGH = 2**63 - 1
SUMS = "part int, entry int, position int, limb int, total decimal(38,0), members long"


class Node(NamedTuple):
    """entries: all below the node; vantage: an entry, or -1 in a leaf; children: (node, least and greatest distance)."""

    entries: np.ndarray
    vantage: int
    children: tuple[tuple[Node, float, float], ...]


def exact_in_floats(a: np.ndarray, b: np.ndarray) -> bool:
    if a.dtype == object or b.dtype == object:
        return False
    return (np.abs(a).max(initial=0) + np.abs(b).max(initial=0)) ** 2 * max(1, a.shape[1]) < _EXACT


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a and b: whole numbers in floats, or Python integers."""
    if exact_in_floats(a, b):
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return ((whole(a)[:, None, :] - whole(b)[None, :, :]) ** 2).sum(2)


def whole(a: np.ndarray) -> np.ndarray:
    return a if a.dtype == object else np.vectorize(int, otypes=[object])(a) if a.size else a.astype(object)


def bounds(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances rounded down and up, by more than the root and the conversion to floats can be off."""
    d = np.sqrt(d2.astype(np.float64))
    return d * (1 - 2.0**-50), d * (1 + 2.0**-50)


def grow(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The vantage-point tree of some entries of a codebook."""
    entries = np.arange(len(book)) if entries is None else entries
    if len(entries) <= LEAF:
        return Node(entries, -1, ())
    # The entry farthest from the first one lies at the edge, where rings are widest.
    far = squared(book[entries[:1]], book[entries])[0]
    vantage = entries[int(np.argmax(far))]
    rest = entries[entries != vantage]
    d2 = squared(book[vantage : vantage + 1], book[rest])[0]
    low, high = bounds(d2)
    order = np.argsort(high, kind="stable")
    children = []
    for half in np.array_split(order, 2):
        children.append((grow(book, np.sort(rest[half])), float(low[half].min()), float(high[half].max())))
    return Node(entries, int(vantage), tuple(children))


class Search:
    """The nearest entries of one tile's parts."""

    def __init__(self, book: np.ndarray, x: np.ndarray):
        self.book, self.x = book, x
        self.entry = np.full(len(x), len(book), np.int64)
        if not exact_in_floats(x, book):
            self.book, self.x = whole(book), whole(x)
        self.best = np.full(len(x), np.inf, self.x.dtype)
        self.met = 0

    def meet(self, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Compares parts with entries (ascending) exactly; their squared distances."""
        d2 = squared(self.x[rows], self.book[entries])
        self.met += d2.size
        at = d2.argmin(axis=1)
        d, e = d2[np.arange(len(rows)), at], entries[at]
        better = (d < self.best[rows]) | ((d == self.best[rows]) & (e < self.entry[rows]))
        self.best[rows[better]], self.entry[rows[better]] = d[better], e[better]
        return d2

    def descend(self, node: Node, rows: np.ndarray) -> None:
        """One leaf for each part: at a node, the child whose ring it is nearer to."""
        while len(rows) and node.vantage >= 0:
            d = bounds(self.meet(rows, np.array([node.vantage]))[:, 0])[0]
            (inner, _, edge), (outer, start, _) = node.children
            first = d <= (edge + start) / 2
            self.descend(inner, rows[first])
            node, rows = outer, rows[~first]
        if len(rows):
            self.meet(rows, node.entries)

    def visit(self, node: Node, rows: np.ndarray) -> None:
        """All entries below the node that can be as near as a part's best."""
        if node.vantage < 0:
            self.meet(rows, node.entries)
            return
        low, high = bounds(self.meet(rows, np.array([node.vantage]))[:, 0])
        for child, least, most in node.children:
            bound = np.maximum(np.maximum(least - high, low - most), 0) * (1 - 2.0**-50)
            keep = bound <= bounds(self.best[rows])[1]
            if keep.any():
                self.visit(child, rows[keep])


def nearest(book: np.ndarray, tree: Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index, and how many pairs were compared."""
    search, rows = Search(book, x), np.arange(len(x))
    if len(x):
        search.descend(tree, rows)
        search.visit(tree, rows)
    return search.entry, search.best, search.met


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of floor(SCALE * x), as floats where these are exact integers, else as Python integers."""
    flat = np.asarray(vectors.flatten().cast(pa.float64()), dtype=np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * flat)
    if not np.isfinite(scaled).all():
        return np.array([int(x) * SCALE if abs(x) > _EXACT else int(np.floor(SCALE * x)) for x in flat.tolist()], object).reshape(len(vectors), dim)
    out = scaled.reshape(len(vectors), dim)
    return out if np.abs(out).max(initial=0) < 2.0**26 else whole(out)


def cuts(dim: int) -> list[tuple[int, int]]:
    return [(k * dim // PARTS, (k + 1) * dim // PARTS) for k in range(PARTS)]


def _tiles(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for s in range(0, batch.num_rows, TILE):
            part = batch.slice(s, TILE)
            yield part, matrix(part.column(part.num_columns - 1), dim)


def _summing(books: list[np.ndarray], trees: list[Node], dim: int):
    """Rows of SUMS for a task: the sums of the parts that are nearest to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for _, x in _tiles(batches, dim):
            for k, (a, b) in enumerate(cuts(dim)):
                entry, _, _ = nearest(books[k], trees[k], x[:, a:b])
                order = np.argsort(entry, kind="stable")
                used, first, members = np.unique(entry[order], return_index=True, return_counts=True)
                part = x[order, a:b]
                totals = np.add.reduceat(part if part.dtype == object else part.astype(np.int64), first, axis=0) if b > a else np.zeros((len(used), 0), np.int64)
                for e, m, t in zip(used.tolist(), members.tolist(), totals.tolist(), strict=True):
                    held = sums.setdefault((k, e), [0, [0] * (b - a)])
                    held[0] += m
                    held[1] = [p + q for p, q in zip(held[1], t, strict=True)]
        rows = []
        for (k, e), (members, totals) in sums.items():
            for position, total in enumerate(totals):
                limb = 0
                while True:
                    left = total if -(1 << _LIMB) <= total < 1 << _LIMB else total & ((1 << _LIMB) - 1)
                    rows.append((k, e, position, limb, left, members))
                    if left == total:
                        break
                    total, limb = total >> _LIMB, limb + 1
        kinds = [pa.int32()] * 4 + [pa.decimal128(38, 0), pa.int64()]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SUMS.split(", ")])

    return run


def _coding(books: list[np.ndarray], trees: list[Node], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _tiles(batches, dim):
            code, error = [""] * len(x), [0] * len(x)
            for k, (a, b) in enumerate(cuts(dim)):
                entry, d2, _ = nearest(books[k], trees[k], x[:, a:b])
                code = [c + f"{e:02x}" for c, e in zip(code, entry.tolist(), strict=True)]
                error = [s + int(d) for s, d in zip(error, d2.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(code, pa.string()), pa.array([min(s, _HIGH) for s in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows whose components are all finite."""
    x = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("embedding").isNotNull() & F.forall("embedding", lambda v: F.coalesce(x(v), F.lit(False))))


def fit(kept: DataFrame) -> tuple[int, list[np.ndarray]]:
    """The length of the vectors and each part position's codebook after ROUNDS rounds; no rows: no codebooks."""
    start = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding")
    first = start.select(F.size("embedding")).limit(1).collect()
    if not first:
        return 0, []
    dim = first[0][0]
    kept = kept.where(F.size("embedding") == dim)
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(ENTRIES).toArrow()
    seeds = matrix(rows.column(0).combine_chunks(), dim)
    books = [seeds[:, a:b].copy() for a, b in cuts(dim)]
    for _ in range(ROUNDS):
        found = kept.select("embedding").mapInArrow(_summing(books, [grow(b) for b in books], dim), SUMS)
        found = found.groupBy("part", "entry", "position", "limb").agg(F.sum("total").alias("total"), F.sum("members").alias("members"))
        totals: dict[tuple, list] = {}
        for r in found.collect():  # at most ENTRIES * length rows, a limb each
            held = totals.setdefault((r.part, r.entry, r.position), [0, 0])
            held[0] += int(r.total) << (_LIMB * r.limb)
            held[1] = max(held[1], r.members)
        books = [b.copy() for b in books]
        for (part, entry, position), (total, members) in totals.items():
            books[part][entry, position] = total // members
    return dim, books


def compress(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of vectors (vec_id, embedding, label)."""
    kept = usable(vectors)
    dim, books = fit(kept)
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for row in b.tolist() for x in row).encode()).hexdigest()
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    kept = kept.where(F.size("embedding") == dim) if books else kept.where(F.lit(False))
    coded = kept.mapInArrow(_coding(books, [grow(b) for b in books], dim), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    coded = materialise(spark, coded, "compression-codes")
    most = F.lit(_HIGH).cast("decimal(38,0)")
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    sums = sums.select(F.col("label").alias("own"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("copy"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    out = salted.join(sums, salted["label"].eqNullSafe(sums["own"]) & (F.col("salt") == F.col("copy")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark, table(spark, sf_dir, "embeddings"))
