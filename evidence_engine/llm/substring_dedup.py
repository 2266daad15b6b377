"""Substring de-duplication: Rabin-Karp hashes of every token window, counted in Spark.

Words are runs of characters other than space and \\x09-\\x0D. A word that a repeated window covers is removed where
the same word sequence also starts in a document with a smaller id. Steps:

1. Each Python worker hashes all windows of its texts, a long text in pieces. Windows that several documents of one chunk
   hold are resolved there (combine before the shuffle): only the records of the smallest id travel on, so a passage that
   a third of all documents share costs one record a chunk, not one a document.
2. The records travel in blobs, one a chunk and bucket. A bucket is a part of the hash space; their number follows the
   input's size, so a bucket's memory is bounded. Of more than FAN buckets, the records first go to groups of buckets and
   from there to the buckets, so a blob never holds just a record or two. In a bucket the smallest document of each hash
   is found.
3. Start positions of removed windows go to their documents and merge into maximal intervals, a table in the shared
   folder. The first shuffle is dropped before texts are joined with it.

A record is a 64-bit hash; the bucket is drawn from a second, independent hash, so two windows of different chunks must
agree in 64 + log2(buckets) bits. Within a chunk, 64 bits mixed from both are compared. The words themselves aren't.

Defined cases: a null or empty text has no words; a null id is never removed from and removes from none; rows with the
same id count as one document; bytes that are no UTF-8 are words' bytes like any others (and U+FFFD where the kept words
are returned as a string); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm.common import WordHashes, cut_at_space, free_shuffles, materialise, mix, pieces, plan_bytes, table, tasks_for, text_slices, texts_of

#: The contract's window, and the windows that a worker holds at once (8 + 8 + 4 + 8 bytes each, twice while sorting).
WINDOW, CHUNK_WINDOWS = 13, 2_000_000
#: Parquet bytes a bucket stands for: about 1.2 million windows of text.
BUCKET_BYTES = 4_000_000
#: Buckets that one chunk's records are dealt to at once.
FAN = 8192
_BLOBS = "bucket long, grp long, blob binary"
_BASE_A, _BASE_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def window_hashes(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two Rabin-Karp hashes, modulo 2**64 over mixed word hashes, of each window of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(size):
        a = a * _BASE_A + words[i : i + n]
        b = b * _BASE_B + words[i : i + n]
    return mix(a), mix(b)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Byte planes of the arrays, compressed: document indexes and gaps are small numbers."""
    head = struct.pack(f"<{len(arrays)}Q", *(len(x) for x in arrays))
    body = b"".join(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in arrays)
    return head + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(blob: bytes, count: int) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{count}Q", blob)
    body = zstandard.ZstdDecompressor().decompress(blob[8 * count :], max_output_size=8 * sum(sizes) + 1)
    out, at = [], 0
    for n in sizes:
        planes = np.frombuffer(body, np.uint8, 8 * n, at).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view("<u8").ravel())
        at += 8 * n
    return out


def _runs(docs: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Records sorted by document as documents, their keys, record counts, and gaps between positions."""
    first = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])]) if len(docs) else np.zeros(0, np.int64)
    gaps = np.diff(pos.astype(np.int64), prepend=0)
    gaps[first] = pos[first]
    return [docs[first].view(np.uint64), keys[first].view(np.uint64), np.diff(np.r_[first, len(docs)]).astype(np.uint64), gaps.astype(np.uint64)]


def _unruns(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, keys, counts, gaps = parts
    counts = counts.astype(np.int64)
    total = np.cumsum(gaps.astype(np.int64))
    first = np.cumsum(counts) - counts
    pos = total - np.repeat(total[first] - gaps[first].astype(np.int64), counts)
    return np.repeat(docs.view(np.int64), counts), np.repeat(keys.view(np.int64), counts), pos


def _first_of_equal(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each record, whether a record of the same hash has a smaller document."""
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    least = np.repeat(d[start], np.diff(np.r_[start, len(h)]))
    later = np.empty(len(h), bool)
    later[order] = d > least
    return later


def _by_bucket(part: np.ndarray, docs: np.ndarray, keys: np.ndarray, pos: np.ndarray, hashes: np.ndarray, fine: np.ndarray | None = None) -> Iterator[tuple[int, None, bytes]]:
    """Records as blobs by bucket: packed runs, the hashes, and where the bucket is a group of buckets, the one in it."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    for s, e in zip(start.tolist(), [*start[1:].tolist(), len(part)], strict=True):
        rows = order[s:e]
        runs = _pack(_runs(docs[rows], keys[rows], pos[rows]))
        tail = b"" if fine is None else fine[rows].astype("<u2").tobytes()
        yield int(part[s]), None, struct.pack("<Q", len(runs)) + runs + hashes[rows].tobytes() + tail


def _records(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Documents, text keys, positions, hashes and, if given, buckets of the records of a blob."""
    (n,) = struct.unpack_from("<Q", blob)
    docs, keys, pos = _unruns(_unpack(blob[8 : 8 + n], 4))
    end = 8 + n + 8 * len(docs)
    fine = np.frombuffer(blob, "<u2", offset=end) if len(blob) > end else None
    return docs, keys, pos, np.frombuffer(blob, "<u8", len(docs), 8 + n), fine


def _blob_batch(rows: list[tuple[int, int | None, bytes]]) -> pa.RecordBatch:
    at, groups, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(groups, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "grp", "blob"])


def _hash_side(size: int, buckets: int, groups: int, chunk: int, width: int):
    """Records of all windows, to buckets; with width over 1, to groups of so many buckets."""
    import xxhash

    def emit(held: list[tuple]) -> pa.RecordBatch:
        docs, keys, pos, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        later = _first_of_equal(a ^ (b << np.uint64(1)), docs)
        rows = []
        if later.any():
            # What is settled already passes through a bucket drawn by its group.
            rows += [(g * width % buckets // width, g, blob) for g, blob in _by_group(docs[later], keys[later], pos[later], groups)]
        docs, keys, pos, a, b = (x[~later] for x in (docs, keys, pos, a, b))
        part = (b % np.uint64(buckets)).astype(np.int64)
        rows += _by_bucket(part // width, docs, keys, pos, a, part % width if width > 1 else None)
        return _blob_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = WordHashes(), [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, end in text_slices(batch):
                for doc, text in zip(ids[start:end], texts_of(batch, start, end), strict=True):
                    if not text or doc is None:
                        continue
                    key = np.int64(np.uint64(xxhash.xxh64_intdigest(text, 42)).astype(np.int64))
                    carried, first = np.zeros(0, np.uint64), 0
                    for part in cut_at_space(text):
                        words = hashes.array(part.split())
                        words = np.concatenate([carried, words]) if len(carried) else words
                        a, b = window_hashes(words, size)
                        carried = words[len(a) :]
                        if len(a):
                            held.append((np.full(len(a), doc, np.int64), np.full(len(a), key, np.int64), np.arange(first, first + len(a)), a, b))
                            first, n = first + len(a), n + len(a)
                        if n >= chunk:
                            yield emit(held)
                            held, n = [], 0
        if held:
            yield emit(held)

    return run


def _split_side(width: int, chunk: int):
    """From groups of buckets to the buckets; what is settled already goes to the group's first."""

    def emit(held: list[tuple[int, tuple]]) -> pa.RecordBatch:
        rows = []
        for group in sorted({g for g, _ in held}):
            docs, keys, pos, hashes, fine = (np.concatenate(x) for x in zip(*(r for g, r in held if g == group), strict=True))
            rows += _by_bucket(group * width + fine.astype(np.int64), docs, keys, pos, hashes)
        return _blob_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for bucket, g, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if g is not None:
                    yield _blob_batch([(bucket * width, g, blob)])
                    continue
                held.append((bucket, _records(blob)))
                n += len(held[-1][1][0])
                if n >= chunk:
                    yield emit(held)
                    held, n = [], 0
        if held:
            yield emit(held)

    return run


def _by_group(docs: np.ndarray, keys: np.ndarray, pos: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Removed starts as blobs by the group of their document."""
    grp = (mix(docs.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((pos, keys, docs, grp))
    docs, keys, pos, grp = docs[order], keys[order], pos[order], grp[order]
    start = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
    for s, e in zip(start.tolist(), [*start[1:].tolist(), len(grp)], strict=True):
        yield int(grp[s]), _pack(_runs(docs[s:e], keys[s:e], pos[s:e]))


def _bucket_side(groups: int):
    def run(tab: pa.Table) -> pa.Table:
        at, out, held = [], [], []
        for g, blob in zip(tab.column("grp").to_pylist(), tab.column("blob").to_pylist(), strict=True):
            if g is not None:
                at.append(g), out.append(blob)
            else:
                held.append(_records(blob)[:4])
        if held:
            docs, keys, pos, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            later = _first_of_equal(hashes, docs)
            if later.any():
                for g, blob in _by_group(docs[later], keys[later], pos[later], groups):
                    at.append(g), out.append(blob)
        return pa.table({"grp": pa.array(at, pa.int64()), "blob": pa.array(out, pa.binary())})

    return run


def _interval_side(size: int):
    """Per document and text: maximal removed word intervals, as int32 pairs (start, end)."""

    def run(tab: pa.Table) -> pa.Table:
        parts = [_unruns(_unpack(x, 4)) for x in tab.column("blob").to_pylist()]
        ids, text_keys, spans = [], [], []
        if parts:
            d, k, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((p, k, d))
            d, k, p = d[order], k[order], p[order]
            new_doc = np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])]
            opens = np.flatnonzero(new_doc | np.r_[True, p[1:] > p[:-1] + size])
            closes = np.r_[opens[1:], len(p)] - 1
            pairs = np.stack([p[opens], p[closes] + size], 1).astype("<i4")
            start = np.flatnonzero(new_doc[opens])
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(opens)], strict=True):
                ids.append(int(d[opens[s]])), text_keys.append(int(k[opens[s]])), spans.append(pairs[s:e].tobytes())
        return pa.table({"id": pa.array(ids, pa.int64()), "text_key": pa.array(text_keys, pa.int64()), "spans": pa.array(spans, pa.binary())})

    return run


def removal_intervals(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, chunk_windows: int = CHUNK_WINDOWS, fan: int = FAN) -> DataFrame:
    """id, text_key (xxhash64 of the text), spans: the maximal word intervals to remove, materialised."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = plan_bytes(own)
    buckets, tasks = pieces(size, bucket_bytes), tasks_for(spark, size)
    groups = max(16, buckets // 4)
    # Two rounds for more than `fan` buckets, each to about the root of their number.
    width = 1 if buckets <= fan else math.isqrt(buckets) + 1
    blobs = own.mapInArrow(_hash_side(window, buckets, groups, chunk_windows, width), _BLOBS)
    if width > 1:
        salt = F.pmod(F.xxhash64("blob"), F.lit(max(1, tasks * width // buckets))).alias("salt")
        blobs = blobs.repartition(tasks, "bucket", salt).mapInArrow(_split_side(width, chunk_windows), _BLOBS)
    found = (
        blobs.repartition(tasks, "bucket")
        .groupBy("bucket")
        .applyInArrow(_bucket_side(groups), "grp long, blob binary")
        .groupBy("grp")
        .applyInArrow(_interval_side(window), "id long, text_key long, spans binary")
    )
    out = materialise(spark, found, "substring-intervals")
    del found, blobs
    free_shuffles(spark)
    return out


def _kept_parts(text: bytes, gone: bytes | None, count: list[int]) -> Iterator[bytes]:
    """The kept words of a text, joined by one space, piece by piece; count gets the words and the removed ones."""
    spans = np.frombuffer(gone or b"", "<i4").reshape(-1, 2)
    ends = spans[:, 1]
    first = 0
    for part in cut_at_space(text):
        words = part.split()
        last, rest, at = first + len(words), [], 0
        k = int(np.searchsorted(ends, first, side="right"))
        while k < len(spans) and spans[k, 0] < last:
            s, e = max(int(spans[k, 0]) - first, 0), min(int(spans[k, 1]) - first, len(words))
            rest += words[at:s]
            count[1] += e - s
            at = e
            k += 1
        words = rest + words[at:] if at else words
        first = last
        if words:
            yield b" ".join(words)
    count[0] = first


def _kept_side(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column(0), batch.column(2).to_pylist()
            words_n, removed_n, kept = [], [], []
            for start, end in text_slices(batch):
                for text, gone in zip(texts_of(batch, start, end), spans[start:end], strict=True):
                    count = [0, 0]
                    parts = _kept_parts(text or b"", gone, count)
                    if digest:
                        h = hashlib.sha256()
                        for k, part in enumerate(parts):
                            if k:
                                h.update(b" ")
                            h.update(part)
                        kept.append(h.hexdigest())
                    else:
                        kept.append(b" ".join(parts).decode("utf-8", "replace"))
                    words_n.append(count[0]), removed_n.append(count[1])
            columns = [ids, pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"])

    return run


def substring_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (`kept`), or with digest their SHA-256."""
    spans = removal_intervals(spark, docs, id_col, text_col, window, **sizes)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    tasks = tasks_for(spark, plan_bytes(own))
    joined = own.repartition(tasks, "id", "text_key").join(spans.repartition(tasks, "id", "text_key"), ["id", "text_key"], "left").select("id", "text", "spans")
    tail = "kept_sha256 string" if digest else "kept string"
    return joined.mapInArrow(_kept_side(digest), f"doc_id long, n_words long, n_removed long, {tail}")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, table(spark, sf_dir, "documents"), digest=True)
