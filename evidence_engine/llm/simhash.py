"""SimHash near-duplicates by a binary-trie self-join.

Texts are lower-cased (A-Z only) and cut into words, runs of characters other than space and \\x09-\\x0D. A
fingerprint's bit is 1 if it is set in over half of the shingles' hashes (XXH64 of the UTF-8 shingle, seed 42).
Equal fingerprints are one record from the start, so a group of exact copies costs one.

The self-join descends the binary trie of the fingerprints with pairs of nodes. A pair carries the number of bits in
which its paths differ, and goes as soon as that exceeds the error budget of its depth. The trie is cut at a depth
that follows the number of fingerprints: the subtree below a prefix is one task's, and a fingerprint is also sent to
the smaller prefixes within the budget, so each pair of subtrees meets in one task. A pair of subtrees whose
fingerprints are already linked with each other goes too, so a dense group of near copies isn't expanded into all its
pairs; a task returns a spanning forest of its links, which leaves the components as they are.

The pipeline's stage takes the trie's pairs as candidates only. A record is there a set of distinct shingles. Candidates
that hang together make a cluster, and within clusters the sets themselves are compared, exactly: a block of a cluster is
one task's, of bounded size, and counts all its sets' common shingles by a matrix product. Of a cluster with several
blocks, each block first joins its own sets; what then isn't in the cluster's largest component visits all blocks, so no
pair is left out and the sets of a large group of copies don't travel.

Defined cases: a null or empty text has fingerprint zero and links like any other; fewer words than a shingle are one
shingle; repeated rows each get their row, and of rows that share an id each its own fingerprint; rows with a null id are
fingerprinted and link others, but name no component: one that only they hold is null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm.common import free_shuffles, materialise, mix, pieces, table, text_slices, texts_of
from evidence_engine.llm.components import FILE_BYTES, components, local_roots

SHINGLE, BITS, BUDGET = 3, 64, 2
#: Fingerprints below a prefix on average; the prefix has 10 bits at least and 20 at most.
SUBTREE = 512


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    import xxhash

    words = text.lower().split() if text else ()
    if not words:
        return []
    norm, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(norm, 42)]
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(norm)]
    return [h(norm[s:e], 42) for s, e in zip(starts, ends[size - 1 :], strict=False)]


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def set_key(shingles: np.ndarray) -> int:
    """The record of all texts with these shingles, as a signed long."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(shingles.tobytes(), 7)
    return h - 2**64 if h >> 63 else h


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority bits (uint64) of consecutive runs of hashes; a run of none gives zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > counts[full][:, None], axis=1).view(">u8").ravel()
    return out


def _fingerprint_side(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, end in text_slices(batch, limit=1_000_000):
                each = [shingle_hashes(x, size) for x in texts_of(batch, start, end)]
                counts = np.array([len(x) for x in each], np.int64)
                flat = np.fromiter((h for x in each for h in x), np.uint64, counts.sum())
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), pa.array(fingerprints(flat, counts).view(np.int64))], names=["doc_id", "f0"])

    return run


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint f0 (64 bits, as a signed long)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_fingerprint_side(shingle), "doc_id long, f0 long")


#: Pairs of fingerprints, and node pairs of the trie, that are worked on at once. The descent keeps up to three times so
#: many node pairs for each bit, 40 bytes each.
AT_ONCE, NODES_AT_ONCE = 1 << 16, 1 << 13

_Pairs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _crossed(ul: np.ndarray, uh: np.ndarray, vl: np.ndarray, vh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of members of the node pairs [ul, uh) x [vl, vh), each once, about AT_ONCE at a time."""
    wide = vh - vl
    total = np.r_[0, np.cumsum((uh - ul) * wide)]
    for first in range(0, int(total[-1]), AT_ONCE):
        flat = np.arange(first, min(first + AT_ONCE, int(total[-1])))
        at = np.searchsorted(total, flat, side="right") - 1
        off = flat - total[at]
        i, j = ul[at] + off // wide[at], vl[at] + off % wide[at]
        once = (ul[at] != vl[at]) | (i < j)
        yield i[once], j[once]


class _Links:
    """The pairs that a task has found linked, and the components that they make."""

    def __init__(self, n: int, link):
        self.n, self.link, self.root = n, link, np.arange(n)
        self.left, self.right = [], []

    def try_pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = (i != j) & (self.root[i] != self.root[j])
        i, j = i[apart], j[apart]
        ok = self.link(i, j)
        if ok.any():
            self.left.append(i[ok].astype(np.int32)), self.right.append(j[ok].astype(np.int32))
            self.root = local_roots(self.n, i[ok], j[ok], self.root)

    def apart(self, ul: np.ndarray, uh: np.ndarray, vl: np.ndarray, vh: np.ndarray) -> np.ndarray:
        """Which node pairs have members that are not all of one component."""
        turns = np.r_[0, np.cumsum(np.r_[False, self.root[1:] != self.root[:-1]])]
        return ~((turns[uh] == turns[ul + 1]) & (turns[vh] == turns[vl + 1]) & (self.root[ul] == self.root[vl]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        none = [np.zeros(0, np.int32)]
        return np.concatenate(self.left or none), np.concatenate(self.right or none)


def trie_pairs(prints: np.ndarray, depth: int, home: int, budget: Sequence[int], link) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (enough of them for the same components) between the subtree `home` and all that are given.

    prints: sorted uint64; depth: bits of a prefix; budget[d]: differing bits allowed in the first d bits; link(i, j):
    which of the pairs of indexes are linked in the end. The descent goes deep before it goes wide, NODES_AT_ONCE node
    pairs at a time, so memory doesn't follow the number of pairs.
    """
    n, one = len(prints), np.uint64(1)
    links = _Links(n, link)
    # Neighbours in sorted order are a cheap first set of links; they let whole subtrees of a dense group go early.
    links.try_pairs(np.arange(n - 1), np.arange(1, n))
    top = (prints >> np.uint64(BITS - depth)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    end = np.r_[start[1:], n]
    own = int(np.searchsorted(top[start], home))
    if own == len(start) or top[start[own]] != home:
        return links.pairs()
    acc = np.bitwise_count(top[start] ^ home).astype(np.int64)
    first: _Pairs = (np.full(len(start), start[own]), np.full(len(start), end[own]), start, end, acc)
    ones: dict[int, np.ndarray] = {}
    todo = [(depth, tuple(x[acc <= budget[depth]] for x in first))]
    while todo:
        d, held = todo.pop()
        if len(held[0]) > NODES_AT_ONCE:
            todo += [(d, tuple(x[k : k + NODES_AT_ONCE] for x in held)) for k in range(0, len(held[0]), NODES_AT_ONCE)]
            continue
        ul, uh, vl, vh, acc = held
        # Pairs of single fingerprints are settled at once; pairs whose members are all linked already go.
        single = (uh - ul == 1) & (vh - vl == 1)
        links.try_pairs(ul[single], vl[single])
        keep = ~single & links.apart(ul, uh, vl, vh)
        ul, uh, vl, vh, acc = (x[keep] for x in held)
        if not len(ul):
            continue
        if d == BITS:
            for i, j in _crossed(ul, uh, vl, vh):
                links.try_pairs(i, j)
            continue
        if d not in ones:
            ones[d] = np.r_[0, np.cumsum(((prints >> np.uint64(BITS - 1 - d)) & one).astype(np.int32))]
        bit = ones[d]
        um, vm = uh - (bit[uh] - bit[ul]), vh - (bit[vh] - bit[vl])
        same = (ul == vl) & (uh == vh)
        below = [(ul, um, vl, vm, acc), (um, uh, vm, vh, acc), (ul, um, vm, vh, acc + 1), (um, uh, vl, vm, acc + 1)]
        below[3] = tuple(x[~same] for x in below[3])
        ul, uh, vl, vh, acc = (np.concatenate(x) for x in zip(*below, strict=True))
        keep = (acc <= budget[d + 1]) & (uh > ul) & (vh > vl)
        todo.append((d + 1, tuple(x[keep] for x in (ul, uh, vl, vh, acc))))
    return links.pairs()


def _star(reps: np.ndarray, root: np.ndarray) -> pa.Table:
    """Components as links from each record to the least of its component, so tasks that find the same say the same."""
    order = np.lexsort((reps, root))
    least = np.empty(len(reps), np.int64)
    first = np.flatnonzero(np.r_[True, root[order][1:] != root[order][:-1]]) if len(reps) else np.zeros(0, np.int64)
    least[order] = np.repeat(reps[order][first], np.diff(np.r_[first, len(reps)]))
    left = np.flatnonzero(least != reps)
    return pa.table({"src": pa.array(reps[left]), "dst": pa.array(least[left])})


def _trie_side(k: int, n_prints: int, depth: int, budget: Sequence[int], total: int):
    def run(key: tuple, tab: pa.Table) -> pa.Table:
        turn, home = divmod(key[0].as_py(), 1 << 32)
        cols = np.stack([np.asarray(tab.column(f"f{j}")).view(np.uint64) for j in range(n_prints)])
        own = cols[k] << np.uint64(turn) | cols[k] >> np.uint64(BITS - turn) if turn else cols[k]
        order = np.argsort(own, kind="stable")
        own, cols, reps = own[order], cols[:, order], np.asarray(tab.column("rep"))[order]
        sizes = np.asarray(tab.column("size"))[order] if "size" in tab.column_names else None

        def link(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.zeros(len(i), bool)
            for s in range(0, len(i), AT_ONCE):
                a, b = i[s : s + AT_ONCE], j[s : s + AT_ONCE]
                near = sum(np.bitwise_count(c[a] ^ c[b]).astype(np.int16) for c in cols) <= total
                # Sets of very different sizes can't be similar.
                out[s : s + AT_ONCE] = near if sizes is None else near & (NUM * np.maximum(sizes[a], sizes[b]) <= DEN * np.minimum(sizes[a], sizes[b]))
            return out

        return _star(reps, local_roots(len(reps), *trie_pairs(own, depth, home, budget, link)))

    return run


def trie_links(spark: SparkSession, reps: DataFrame, n: int, n_prints: int = 1, budget: Sequence[int] | None = None, total: int = BUDGET, subtree: int = SUBTREE, turns: Sequence[int] = (0,)) -> DataFrame:
    """src, dst: a spanning forest of each task's links between the distinct records reps(rep, f0, ...).

    Linked are records that, for some k and some turn, stay within budget[d] differing bits in the first d
    bits of fk, rotated left by the turn, for all d from the cut down, and within `total` differing bits over all
    fingerprints; with reps.size, also within the ratio of sizes that the stage's similarity allows. By default the budget
    is `total` throughout, which with one fingerprint finds every pair of `total` or fewer differing bits. One fingerprint's
    tries are joined after another's, so there is one shuffle at a time on disk.
    """
    depth = int(max(10, min(20, math.ceil(math.log2(max(n, 1) / subtree + 1)))))
    budget = [total] * (BITS + 1) if budget is None else list(budget)
    masks = [m for m in range(1 << depth) if m.bit_count() <= budget[depth]]
    out = None
    for k in range(n_prints):
        sent = None
        for turn in turns:
            f = F.col(f"f{k}")
            prefix = F.shiftrightunsigned(F.shiftleft(f, turn).bitwiseOR(F.shiftrightunsigned(f, BITS - turn)) if turn else f, BITS - depth)
            part = reps.select("*", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("m")).withColumn("home", prefix.bitwiseXOR(F.col("m"))).where(F.col("home") <= prefix).drop("m")
            part = part.withColumn("home", F.col("home") + F.lit(turn << 32)) if turn else part
            sent = part if sent is None else sent.unionByName(part)
        links = sent.groupBy("home").applyInArrow(_trie_side(k, n_prints, depth, budget, total), "src long, dst long")
        if n_prints > 1:
            # A forest has fewer links than records: it is written in files of its size, not one a task.
            links = materialise(spark, links.repartition(pieces(16 * n, FILE_BYTES, least=1)), "simhash-links")
            free_shuffles(spark)
        out = links if out is None else out.unionByName(links)
    return out


def simhash_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, f0, component_id (the smallest id reachable over links, the document's own included)."""
    prints = materialise(spark, fingerprint_table(docs, id_col, text_col, shingle), "simhash-prints")
    # A fingerprint is its own record's key, so those that only rows without an id hold link others, too.
    reps = materialise(spark, prints.groupBy("f0").agg(F.min("doc_id").alias("least")), "simhash-reps")
    comps = components(spark, trie_links(spark, reps.select("f0", F.col("f0").alias("rep")), reps.count()))
    named = reps.join(comps, reps.f0 == comps.node, "left").select("f0", "least", F.coalesce("component", "f0").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(spark, named.join(ids, "component").select("f0", "component_id"), "simhash-names")
    return prints.join(named, ["f0"]).select("doc_id", "f0", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


#: The pipeline's stage: sets of distinct five-word shingles, linked at a similarity of NUM / DEN or more. Two sets of
#: similarity J differ in each bit with probability acos(2J / (1 + J)) / pi: 0.15 at J = 0.8. Candidates differ in at most
#: STAGE_TOTAL of the 512 bits of eight fingerprints, 78 being expected at 0.8 with a deviation of 8.
STAGE_SHINGLE, STAGE_PRINTS, STAGE_SUBTREE, NUM, DEN = 5, 8, 4096, 4, 5
STAGE_TOTAL = 104
#: Bytes of shingles, and sets, of a cluster's block; entries of the matrix that counts common shingles.
BLOCK_BYTES, BLOCK_SETS, DENSE = 16 << 20, 4096, 1 << 23
#: Each fingerprint has a trie for each of these rotations, so there are 24. A pair is met if in one of them it differs in
#: at most one of the first 16 bits, two of 22, and from there in one more for every three bits. That doesn't depend on the
#: cut, so the number of documents doesn't change which pairs are met: 0.997 of those at 0.8.
STAGE_TURNS = (0, 21, 42)
STAGE_BUDGET = [1 if d <= 16 else min(16, 2 + max(0, d - 20) // 3) for d in range(BITS + 1)]


def _set_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end in text_slices(batch, limit=1_000_000):
            sets = [shingle_set(x, STAGE_SHINGLE) for x in texts_of(batch, start, end)]
            counts = np.array([len(x) for x in sets], np.int64)
            flat = np.concatenate(sets)
            prints = [fingerprints(flat if k == 0 else mix(flat ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)), counts) for k in range(STAGE_PRINTS)]
            own = batch.slice(start, end - start)
            cols = [own.column("doc_id"), own.column("text_hash"), pa.array([set_key(x) for x in sets], pa.int64()), pa.array(counts), *(pa.array(x.view(np.int64)) for x in prints)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "rep", "size", *(f"f{k}" for k in range(STAGE_PRINTS))])


def _shingle_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (..., text) with the text's shingles in its place."""
    for batch in batches:
        for start, end in text_slices(batch, limit=1_000_000):
            sets = [shingle_set(x, STAGE_SHINGLE) for x in texts_of(batch, start, end)]
            ends = pa.array(np.cumsum([0, *(len(x) for x in sets)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
            part = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*batch.schema.names[:-1], "shingles"])


def _row_key() -> list:
    """What names a row: its id and its text's hash."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")]


def _common(own: np.ndarray, at: np.ndarray, n: int, vocabulary: int, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, counts [row, set]) of common shingles between some of n sets and all; own and at: the shared shingles' numbers
    and their sets'."""
    if n * vocabulary <= DENSE:
        dense = np.zeros((n, vocabulary), np.float32)
        dense[at, own] = 1
        for s in range(0, len(rows), 256):
            yield rows[s : s + 256], dense[rows[s : s + 256]] @ dense.T
        return
    by_set, by_shingle = np.argsort(at, kind="stable"), np.argsort(own, kind="stable")
    first_of = np.searchsorted(at[by_set], np.arange(n + 1))
    sets, start = at[by_shingle], np.searchsorted(own[by_shingle], np.arange(vocabulary + 1))
    for r in rows.tolist():
        mine = own[by_set[first_of[r] : first_of[r + 1]]]
        held = [sets[start[v] : start[v + 1]] for v in mine.tolist()]
        yield np.array([r]), np.bincount(np.concatenate(held) if held else sets[:0], minlength=n)[None, :]


def exact_roots(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The components of sets that have a similarity of NUM / DEN or more, rows being compared with all."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    root = np.arange(n)
    if not sizes.sum():
        return root
    _, number, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle of one set alone is common to none.
    shared = seen[number] > 1
    ids = np.cumsum(seen > 1) - 1
    own, at = ids[number[shared]], np.repeat(np.arange(n), sizes)[shared]
    vocabulary = int((seen > 1).sum())
    if not vocabulary:
        return root
    for some, counts in _common(own, at, n, vocabulary, rows):
        # |A & B| / |A | B| >= NUM / DEN, in integers.
        enough = (NUM + DEN) * counts.astype(np.int64) >= NUM * (sizes[some][:, None] + sizes[None, :])
        i, j = np.nonzero(enough & (counts > 0))
        root = local_roots(n, some[i], j, root)
    return root


def _exact_side(tab: pa.Table) -> pa.Table:
    """The verified components of a block, as links; with visitors, only they are compared with all."""
    reps, visits = np.asarray(tab.column("rep")), np.asarray(tab.column("visitor"))
    lists = tab.column("shingles").combine_chunks()
    offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    sets = [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return _star(reps, exact_roots(sets, np.flatnonzero(visits) if visits.any() else np.arange(len(reps))))


_EXACT = "src long, dst long"
_COLUMNS = {"visitor": "boolean", "parts": "int"}


def similar_links(spark: SparkSession, docs: DataFrame, sets: DataFrame, clusters: DataFrame, block_bytes: int = BLOCK_BYTES, block_sets: int = BLOCK_SETS) -> DataFrame:
    """src, dst: links that join the sets(rep, size, holder) of each cluster(node, component) that are connected by pairs of
    a similarity of NUM / DEN or more, and no others."""
    own = sets.select("rep", "size", "holder").join(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    own = materialise(spark, own, "near-members")
    parts = F.greatest(F.ceil(F.sum(F.col("size") * 8) / block_bytes), F.ceil(F.count("*") / block_sets)).cast("int")
    placed = own.join(own.groupBy("cluster").agg(F.greatest(parts, F.lit(1)).alias("parts")), "cluster").select("holder.*", "rep", "cluster", "parts", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("block"))
    texts = docs.select(*_row_key(), "text")

    def members(some: DataFrame, columns: str) -> DataFrame:
        """The sets of some of the placed records, made of their texts anew, so that they are shuffled once and never stored. A
        row that is there twice gives its set twice, which joins nothing else."""
        met = texts.join(some.hint("shuffle_hash"), ["doc_id", "text_hash"]).select("cluster", "block", "rep", *columns.split(), "text")
        return met.mapInArrow(_shingle_side, f"cluster long, block int, rep long, {', '.join(f'{c} {_COLUMNS[c]}' for c in columns.split())}, shingles array<long>")

    files = pieces(16 * own.count(), FILE_BYTES, least=1)
    at_home = members(placed.withColumn("visitor", F.lit(False)), "visitor")
    links = at_home.groupBy("cluster", "block").applyInArrow(_exact_side, _EXACT)
    links = materialise(spark, links.repartition(files), "near-links")
    free_shuffles(spark)
    wide = materialise(spark, placed.where("parts > 1"), "near-wide")
    if wide.isEmpty():
        return links
    joined = components(spark, links).withColumnRenamed("node", "rep")
    wide = wide.join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    largest = wide.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    sets_of = members(wide.join(largest, "cluster").withColumn("visitor", F.col("component") != F.col("largest")), "visitor parts")
    # What isn't in the cluster's largest component visits every block; the rest stays at home.
    blocks = F.when(F.col("visitor"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("block"))
    more = sets_of.select("cluster", F.explode(blocks).alias("block"), "rep", "visitor", "shingles").groupBy("cluster", "block").applyInArrow(_exact_side, _EXACT)
    out = links.unionByName(materialise(spark, more.repartition(files), "near-links"))
    free_shuffles(spark)
    return out


def near_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, component for each row with an id."""
    names = [f"f{k}" for k in range(STAGE_PRINTS)]
    prints = docs.where("doc_id is not null").select(*_row_key(), "text").mapInArrow(_set_side, "doc_id long, text_hash long, rep long, size long, " + ", ".join(f"{x} long" for x in names))
    prints = materialise(spark, prints, "near-prints")
    sets = materialise(spark, prints.groupBy("rep", "size", *names).agg(F.min(F.struct("doc_id", "text_hash")).alias("holder")), "near-reps")
    candidates = trie_links(spark, sets.drop("holder"), sets.count(), n_prints=STAGE_PRINTS, budget=STAGE_BUDGET, total=STAGE_TOTAL, subtree=STAGE_SUBTREE, turns=STAGE_TURNS)
    links = similar_links(spark, docs, sets, components(spark, candidates))
    joined = components(spark, links).withColumnRenamed("node", "rep")
    return prints.select("doc_id", "text_hash", "rep").join(joined, "rep", "left").select("doc_id", "text_hash", F.coalesce("component", "rep").alias("component"))


def drop_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the near copies: of each component, the row of the smallest doc_id (and text's hash) stays, once.

    Defined cases: a row goes by its own text, whatever other rows have its doc_id; of repeated rows (id and text) one
    stays at most; rows with a null doc_id stay and link nothing; null and empty texts are copies of each other, as their
    sets are both empty; an empty table stays empty; docs may have columns of any names beside doc_id and text.
    """
    found = near_components(spark, docs).groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    found = materialise(spark, found, "near-components")
    row = F.struct("doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(row).alias("kept"))
    ruled = found.join(first, "component").select("doc_id", "text_hash", "n", (row == F.col("kept")).alias("stays"))
    # Rows of one id and text are one row: they all go, and where they are the first of their component one comes back.
    ruled = materialise(spark, ruled.where("n > 1 or not stays"), "near-rows").select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), "stays")
    same = (F.col("doc_id").cast("long") == F.col("_doc_id")) & (F.xxhash64("text") == F.col("_text_hash"))
    left = docs.join(ruled, same, "left_anti")
    if ruled.where("stays").isEmpty():
        return left
    again = docs.join(ruled.where("stays"), same, "left_semi").withColumn("_text_hash", F.xxhash64("text"))
    return left.unionByName(again.dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash"))
