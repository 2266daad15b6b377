"""Hierarchical multi-length packing of tokenised documents.

A document is its token ids and an end id. Full windows are cut from it first. What is left goes to the smallest
context-size tier that holds it (256, 512, 1024 or 2048 ids). Tiers are packed from the longest down: a window opens
with the tier's longest remainder, whole shorter documents fill its gap by best fit, and what is left of the gap is cut
from a shorter one, so windows are exactly full. What a task holds at its end is cut at powers of two, which need no
padding either. Sequences go to step groups of equally many ids.

Everything is decided from a task's own rows in one pass over the input: no shuffle, a bounded pool of documents in
memory, and a lost executor's tasks are just run again. A sequence's id has the partition's number in its upper bits.

Defined cases: a null text is an empty one, whose document is the end id alone; an id column's nulls and repeats are
passed on; bytes that are no UTF-8 are read as U+FFFD; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm.common import SLICE_BYTES, cut_at_space, table, text_slices, texts_of

MAX_LENGTH, END_ID, TIERS = 2048, 1, (256, 512, 1024, 2048)
#: Ids that a task's pool holds, ids of a step group, and words that a worker remembers.
POOL_IDS, STEP_IDS, REMEMBERED = 2_000_000, 8 * 2048, 400_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Stands for the end of a word in _byte_pairs.
_END = "\0"


def _byte_pairs(vocab: dict[str, int]):
    """The vocabulary's byte-pair merges for words of lower-case letters, each with _END behind it.

    Ids are in the order of the merges, and every token is its own encoding, so merging the pair of the smallest id
    first gives the tokenizer's ids. A letter's byte and the word's end are one symbol from the start: these symbols have
    smaller ids than all merges.
    """
    import tiktoken

    # The usual byte alphabet, printable bytes as themselves and the rest from U+0100 on.
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    byte = {chr(b): bytes([b]) for b in kept} | {chr(256 + k): bytes([b]) for k, b in enumerate(rest)}
    ranks = {}
    for token, i in vocab.items():
        word, end = (token[:-4], _END.encode()) if token.endswith("</w>") else (token, b"")
        if word and all(c in byte for c in word) and not token.startswith("<|"):
            ranks[b"".join(byte[c] for c in word) + end] = i
    ranks[_END.encode()] = max(vocab.values()) + 1
    return tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})


#: A word of Latin-1 letters, and behind them a run of ASCII punctuation without the apostrophe: one or two pre-tokens.
_PLAIN = re.compile(r"^([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)$", re.M)


class _Places(dict):
    """word -> its place in order of first sight; `new` lists the words that were added."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordTokens:
    """Token ids of texts, through a memory of words.

    The tokenizer drops white space and never merges across it, so a text's ids are its words' ids in order. New words
    are encoded together: plain ones by _byte_pairs, all others by the tokenizer itself.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        vocab = self.tok.get_vocab()
        self.merge = _byte_pairs(vocab)
        self.closes = np.zeros(max(vocab.values()) + 2, bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.words = _Places()
        self.arena, self.used = np.zeros(1 << 20, np.uint32), 0
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _store(self, places: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        while self.used + len(flat) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
        self.arena[self.used : self.used + len(flat)] = flat
        self.at[places], self.size[places] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(flat)

    def _learn(self, words: list[bytes]) -> None:
        first = len(self.words) - len(words)
        while len(self.words) > len(self.at):
            self.at, self.size = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.size, np.zeros_like(self.size)])
        marked = _PLAIN.sub(f"\\1{_END}\\2{_END}", b"\n".join(words).decode("utf-8", "replace")).split("\n")
        plain = np.array([w.endswith(_END) for w in marked])
        # A word that holds _END itself is none of _PLAIN's; white space other than ASCII's stays within a word.
        plain &= np.array([_END.encode() not in w for w in words])
        for s in range(0, len(words), 4096):
            part = np.flatnonzero(plain[s : s + 4096]) + s
            if not len(part):
                continue
            held = [marked[i] for i in part.tolist()]
            ids = np.array(self.merge.encode_ordinary("".join(held).lower()), np.int64)
            # The last pre-token of each word: one or two closing tokens.
            n = np.cumsum([1 if w[-2] == _END else 2 for w in held])
            ends = np.flatnonzero(self.closes[ids])[n - 1] + 1
            self._store(first + part, np.diff(np.r_[0, ends]), ids)
        odd = np.flatnonzero(~plain)
        if len(odd):
            each = [e.ids for e in self.tok.encode_batch_fast([words[i].decode("utf-8", "replace") for i in odd.tolist()], add_special_tokens=False)]
            sizes = np.array([len(x) for x in each], np.int64)
            self._store(first + odd, sizes, np.fromiter((i for x in each for i in x), np.uint32, int(sizes.sum())))

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.words) > self.most:
            self.reset()
        place = self.words.__getitem__
        words = [np.fromiter(map(place, w), np.int64, len(w)) for w in (t.split() for t in texts)]
        if self.words.new:
            self._learn(self.words.new)
            self.words.new = []
        out = []
        for idx in words:
            sizes = self.size[idx]
            before = np.cumsum(sizes) - sizes
            out.append(self.arena[np.repeat(self.at[idx] - before, sizes) + np.arange(sizes.sum())])
        return out

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text. A long text goes in pieces, so only a piece's words are held as objects."""
        if sum(len(t or b"") for t in texts) <= 2 * SLICE_BYTES:
            return self._encode([t or b"" for t in texts])
        return [np.concatenate([self._encode([part])[0] for part in cut_at_space(t or b"")]) for t in texts]


class _Packer:
    """Packs the documents that it is given; pieces are (document, start, length) within sequences."""

    def __init__(self, partition: int):
        self.next_seq = self.next_group = partition << 32
        self.open_groups: list[list[int]] = []  # [room, group]
        self.rest: list[tuple[int, int, int]] = []  # (length, document, start)
        self.docs: dict[int, tuple[int | None, np.ndarray]] = {}
        self.count, self.held, self.rows = 0, 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, n = self.count, len(ids)
        self.count += 1
        self.held += n
        self.docs[key] = (doc_id, ids)
        full = n // MAX_LENGTH * MAX_LENGTH
        for s in range(0, full, MAX_LENGTH):
            self._close([(MAX_LENGTH, key, s)], MAX_LENGTH)
        if n > full:
            self.rest.append((n - full, key, full))

    def _close(self, items: list[tuple[int, int, int]], size: int) -> None:
        seq = self.next_seq
        self.next_seq += 1
        fits = [g for g in self.open_groups if g[0] >= size]
        if fits:
            group = min(fits)
        else:
            group = [STEP_IDS, self.next_group]
            self.next_group += 1
            self.open_groups.append(group)
        group[0] -= size
        if not group[0]:
            self.open_groups.remove(group)
        at = 0
        for length, key, start in items:
            doc_id, ids = self.docs[key]
            self.rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), len(ids), seq, at, size, group[1]))
            at += length

    def pack(self, last: bool = False) -> list[tuple]:
        """Packs the pool; what fills no window stays for the next one, or is cut at powers of two if this is the last."""
        pool = sorted(self.rest)
        lengths = [x[0] for x in pool]
        left: list[tuple[int, int, int]] = []
        while pool:
            item = pool.pop()
            lengths.pop()
            tier = next(t for t in TIERS if t >= item[0])
            held, gap = [item], tier - item[0]
            while gap and pool:
                i = bisect_right(lengths, gap) - 1
                if i >= 0:
                    part = pool.pop(i)
                    lengths.pop(i)
                    held.append(part)
                    gap -= part[0]
                else:
                    # The shortest is longer than the gap: cut the rest of the gap from it.
                    n, key, start = pool.pop(0)
                    lengths.pop(0)
                    held.append((gap, key, start))
                    insort(pool, (n - gap, key, start + gap))
                    insort(lengths, n - gap)
                    gap = 0
            if gap:
                left += held
            else:
                self._close(held, tier)
        self.rest = left
        if last:
            self._tail()
        rows, self.rows = self.rows, []
        self.docs = {x[1]: self.docs[x[1]] for x in self.rest}
        self.held = sum(len(ids) for _, ids in self.docs.values())
        return rows

    def _tail(self) -> None:
        total = sum(x[0] for x in self.rest)
        while total:
            size = min(MAX_LENGTH, 1 << (total.bit_length() - 1))
            items, room = [], size
            while room:
                n, key, start = self.rest.pop()
                items.append((min(n, room), key, start))
                if n > room:
                    self.rest.append((n - room, key, start + room))
                room -= min(n, room)
            self._close(items, size)
            total -= size


def _pack_side(path: str):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, end = WordTokens(path), _Packer(TaskContext.get().partitionId()), np.array([END_ID], np.uint32)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for s, e in text_slices(batch):
                for doc_id, x in zip(ids[s:e], tokens.encode(texts_of(batch, s, e)), strict=True):
                    packer.add(doc_id, np.concatenate([x, end]))
                if packer.held >= POOL_IDS and (rows := packer.pack()):
                    yield batch_of(rows)
        if rows := packer.pack(last=True):
            yield batch_of(rows)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row for each piece of a document in a sequence; tier is the sequence's length."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_pack_side(vocabulary or default_vocabulary()), SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
