"""Benchmark decontamination by template windows.

A text's tokens are its words without punctuation at their ends; tokens without a letter or digit are left out. In the
template, numbers, names (capitalised words) and units are typed placeholders; other tokens are lower-cased. Steps:

1. The benchmark's windows become a table (hash, item): WINDOW tokens of the template with LEAST_LITERALS literal ones or
   more, and LEAST_TOKENS lower-cased tokens as they are (verbatim windows), or the whole of a shorter item.
2. Documents stream past the set of these hashes. A document that has some of them is written down once, with them.
3. Those are hash-joined with the benchmark's windows, which gives each document its candidate items.
4. For each candidate, matching windows that lie on one diagonal form regions, which grow over the tokens next to them as
   long as the templates agree. Slots must be consistent: equal values of the item stand for equal values of the
   document. So a question with other numbers or names is caught, and a chance match of placeholders is not. A document
   is contaminated by an item if consistent regions of one diagonal cover LEAST_TOKENS tokens, or the whole of a shorter
   item; or if one region of so many tokens is consistent by itself; or if so many tokens in a row are the item's own,
   whatever the slots beside them hold.

The set of step 2 is sent to the workers, so the benchmark is cut into blocks of items with about BLOCK_WINDOWS windows
(8 bytes each): a larger benchmark costs more passes over the documents, not more memory, and one block is on the driver
at a time. In step 3 a window of many items and many documents is a hot key; the items' side is salted, so its rows are
dealt to several tasks.

Defined cases: a null or empty text matches nothing; items without a token match nothing; templates of fewer than
LEAST_LITERALS literal tokens match nothing, as placeholders alone say little, so where an item has no better ones it
matches verbatim only; repeated document ids are rows of their own, and of items that share an id one counts; bytes that are no UTF-8 are read as U+FFFD; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm.common import SLICE_BYTES, WordHashes, cut_at_space, materialise, mix, pieces, table, text_slices, texts_of

#: Tokens of a window, literal tokens that it needs, tokens that a region needs.
WINDOW, LEAST_LITERALS, LEAST_TOKENS = 8, 4, 13
#: Windows of the benchmark that a worker holds at once, characters that stand for one, and the join's salts.
BLOCK_WINDOWS, WINDOW_CHARS, SALTS = 2_000_000, 3, 8
#: Bytes of texts whose windows are looked up together; arrays of their tokens stay in a core's cache.
TOGETHER_BYTES = 256_000
#: Items whose tokens a worker remembers.
REMEMBERED_ITEMS = 20_000
# Unit words.
UNITS = frozenset(
    "mm cm km ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml liter liters litre litres gallon gallons sec secs second seconds min mins minute minutes hr hrs hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur gbp percent degree degrees hz khz mhz ghz kb mb gb tb kw".split()
)
_CORE = re.compile(r"^[\W_]+|[\W_]+$")
_NUM, _NAME, _UNIT = 1, 2, 3


def token_of(word: str) -> tuple[int, str, str] | None:
    """(kind, template token, value) of a word; kind 0 is a literal; None for a word of punctuation."""
    core = _CORE.sub("", word)
    if not core:
        return None
    low = core.lower()
    if any(c.isdigit() for c in core):
        return _NUM, "<num>", low
    if low in UNITS:
        return _UNIT, "<unit>", low
    if core[0].isupper() and not core.isupper():
        return _NAME, "<name>", low
    return 0, low, low


class Tokens(dict):
    """word -> place in `kept` of two hashes, zero for words that are left out: the template's, whose lowest bit tells
    literals (1) from placeholders (0), and the lower-cased token's."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.hash, self.most, self.kept = WordHashes().hash, most, np.zeros((2, 1024), np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at == self.kept.shape[1]:
            self.kept = np.concatenate([self.kept, np.zeros_like(self.kept)], axis=1)
        token = token_of(word.decode("utf-8", "replace"))
        self.kept[:, at] = (0, 0) if token is None else (self.hash(token[1].encode(), 9) & ~1 | (token[0] == 0), self.hash(token[2].encode(), 11) | 1)
        return at

    def arrays(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.kept[:, at]


_BASE = 0x9E3779B97F4A7C15


def _windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` tokens: polynomials modulo 2**64, put together from windows of powers of two."""
    n, block, reach, out, width = len(tokens) - size + 1, tokens, 1, None, 0
    while True:
        if size & reach:
            m = len(tokens) - (width + reach) + 1
            out = block[:m] if out is None else block[:m] * np.uint64(pow(_BASE, width, 2**64)) + out[reach : reach + m]
            width += reach
        if width == size:
            return mix(out[:n] + np.uint64(size))
        m = len(block) - reach
        block = block[:m] * np.uint64(pow(_BASE, reach, 2**64)) + block[reach : reach + m]
        reach *= 2


def tokens_of(text: bytes, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Template hashes, hashes of the lower-cased tokens, and the words."""
    words = text.split()
    h, raw = tokens.arrays(words)
    if not h.all():
        words = [w for w, x in zip(words, h.tolist(), strict=True) if x]
        h, raw = h[h != 0], raw[h != 0]
    return h, raw, words


Windows = dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


class Item:
    """A benchmark item: its tokens' hashes and values, and its windows (hashes and places) of either kind."""

    def __init__(self, item_id: int, text: bytes, tokens: Tokens, window: int = WINDOW, literals: int = LEAST_LITERALS, least: int = LEAST_TOKENS):
        self.item_id = item_id
        self.template, self.raw, words = tokens_of(text, tokens)
        self.values = [token_of(w.decode("utf-8", "replace"))[::2] for w in words]
        n = len(self.template)
        self.size, self.raw_size = min(window, n), min(least, n)
        if not n:
            self.places = self.hashes = self.raw_hashes = np.zeros(0, np.uint64)
            return
        literal = np.r_[0, np.cumsum((self.template & np.uint64(1)).astype(np.int64))]
        self.places = np.flatnonzero(literal[self.size :] - literal[: n - self.size + 1] >= literals)
        self.hashes = _windows(self.template, self.size)[self.places]
        self.raw_hashes = _windows(self.raw, self.raw_size)


class Index:
    """Windows of some benchmark items, sorted by hash, by window length: of templates, and of tokens as they are."""

    def __init__(self, items: Iterable[Item]):
        self.items = [x for x in items if len(x.template)]
        templates: Windows = defaultdict(list)
        verbatim: Windows = defaultdict(list)
        for k, x in enumerate(self.items):
            if len(x.places):
                templates[x.size].append((x.hashes, np.full(len(x.places), k), x.places))
            verbatim[x.raw_size].append((x.raw_hashes, np.full(len(x.raw_hashes), k), np.arange(len(x.raw_hashes))))
        self.tables, self.verbatim = _sorted(templates), _sorted(verbatim)


def _sorted(found: Windows) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = {}
    for size, parts in found.items():
        h, item, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        out[size] = h[order], item[order], pos[order]
    return out


def _grown(item: np.ndarray, doc: np.ndarray, diagonal: int, starts: list[int]) -> list[int]:
    """Places of the item whose hash agrees with the document's on a diagonal, in runs that hold a window's start."""
    first, last = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    same = item[first:last] == doc[first + diagonal : last + diagonal]
    run = np.cumsum(np.r_[True, same[1:] != same[:-1]])
    return (first + np.flatnonzero(same & np.isin(run, run[np.array(starts) - first]))).tolist()


def _seeds(h: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[tuple[int, int], list[int]]:
    """(item, diagonal) -> the places in the item of the windows that it shares with the document."""
    seeds: dict[tuple[int, int], list[int]] = defaultdict(list)
    for size, (keys, item, pos) in tables.items():
        if len(h) < size:
            continue
        own = _windows(h, size)
        at = np.searchsorted(keys, own)
        hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == own)
        for p, k in zip(hit.tolist(), at[hit].tolist(), strict=True):
            while k < len(keys) and keys[k] == own[p]:
                q = int(pos[k])
                seeds[int(item[k]), p - q].append(q)
                k += 1
    return seeds


def _judge(item: Item, words: list[bytes], diagonal: int, covered: list[int], least: int) -> tuple[int, int, bool] | None:
    """(covered tokens, slots, whether all slots are verbatim) if what is covered on a diagonal contaminates."""
    if len(covered) < min(least, len(item.values)):
        return None
    stands: dict[tuple[int, str], str] = {}
    clear, same, slots, enough = True, True, 0, False
    for region in np.split(covered, np.flatnonzero(np.diff(covered) != 1) + 1):
        here: dict[tuple[int, str], str] = {}
        here_clear, own_run, longest = True, 0, 0
        for q in region.tolist():
            kind, value = item.values[q]
            other = token_of(words[q + diagonal].decode("utf-8", "replace"))[2] if kind else value
            if kind:
                slots += 1
                same &= other == value
                clear &= stands.setdefault((kind, value), other) == other
                here_clear &= here.setdefault((kind, value), other) == other
            own_run = own_run + 1 if other == value else 0
            longest = max(longest, own_run)
        enough |= longest >= least or (here_clear and len(region) >= least)
    return (len(covered), slots, same) if clear or enough else None


def matches(text: bytes, index: Index, tokens: Tokens, least: int = LEAST_TOKENS) -> list[tuple[int, int, int, bool]]:
    """(item id, covered tokens, slots, whether all slots are verbatim) of each item that contaminates the text."""
    h, raw, words = tokens_of(text, tokens)
    best: dict[int, tuple[int, int, bool]] = {}
    for (i, diagonal), starts in _seeds(h, index.tables).items():
        found = _judge(index.items[i], words, diagonal, _grown(index.items[i].template, h, diagonal, starts), least)
        if found:
            best[i] = max(best.get(i, (0, 0, False)), found, key=lambda r: r[0])
    for (i, diagonal), starts in _seeds(raw, index.verbatim).items():
        item = index.items[i]
        covered = _grown(item.raw, raw, diagonal, starts)
        if len(covered) >= min(least, len(item.values)):
            found = len(covered), sum(item.values[q][0] > 0 for q in covered), True
            best[i] = max(best.get(i, (0, 0, False)), found, key=lambda r: r[0])
    return [(index.items[i].item_id, *found) for i, found in best.items()]


def _window_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = Tokens()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for s, e in text_slices(batch):
            hashes, owners, shapes = [], [], []
            for item_id, text in zip(ids[s:e], texts_of(batch, s, e), strict=True):
                item = Item(item_id, text or b"", tokens)
                for kind, size, own in ((0, item.size, item.hashes), (1, item.raw_size, item.raw_hashes)):
                    own = np.unique(own).view(np.int64)
                    hashes.append(own), owners.append(np.full(len(own), item_id, np.int64)), shapes.append(np.full(len(own), 2 * size + kind, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (hashes, owners, shapes)], names=["hash", "item_id", "shape"])


class _Filter:
    """The set of a block's window hashes, and the lengths of its windows: of templates and of tokens as they are."""

    def __init__(self, hashes: np.ndarray, shapes: list[int]):
        self.hashes = np.sort(hashes.view(np.uint64))
        self.sizes = [sorted(x // 2 for x in shapes if x % 2 == kind) for kind in (0, 1)]
        self.reach = max((x // 2 for x in shapes), default=1)
        # Most windows are told apart by their first bits.
        self.bits = max(16, min(24, int(len(hashes)).bit_length() + 8))
        self.first = np.zeros(1 << self.bits, bool)
        self.first[self.hashes >> np.uint64(64 - self.bits)] = True

    def hits(self, text: bytes, tokens: Tokens) -> np.ndarray:
        """The distinct hashes of the set among the text's windows."""
        found = []
        kept = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        for part in cut_at_space(text):
            for kind, own in enumerate(tokens_of(part, tokens)[:2]):
                own = np.concatenate([kept[kind], own]) if len(kept[kind]) else own
                for size in self.sizes[kind]:
                    if size <= len(own):
                        w = _windows(own, size)
                        w = w[self.first[w >> np.uint64(64 - self.bits)]]
                        if len(w):
                            at = np.minimum(np.searchsorted(self.hashes, w), len(self.hashes) - 1)
                            found.append(w[self.hashes[at] == w])
                kept[kind] = own[max(0, len(own) - self.reach + 1) :]
        return np.unique(np.concatenate(found)) if found else kept[0][:0]

    def hits_of(self, texts: list[bytes | None], tokens: Tokens) -> list[np.ndarray]:
        """hits of each text: windows over the tokens of all of them, without those that reach over a text's end."""
        if sum(len(t or b"") for t in texts) > SLICE_BYTES:
            return [self.hits(t or b"", tokens) for t in texts]
        split = [(t or b"").split() for t in texts]
        doc = np.repeat(np.arange(len(texts)), [len(words) for words in split])
        own = tokens.arrays([w for words in split for w in words])
        if not own[0].all():
            own, doc = own[:, own[0] != 0], doc[own[0] != 0]
        docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for kind in (0, 1):
            for size in self.sizes[kind]:
                if size <= len(doc):
                    w = _windows(own[kind], size)
                    at = np.flatnonzero(self.first[w >> np.uint64(64 - self.bits)])
                    at = at[doc[at] == doc[at + size - 1]]
                    at = at[self.hashes[np.minimum(np.searchsorted(self.hashes, w[at]), len(self.hashes) - 1)] == w[at]]
                    docs.append(doc[at])
                    hashes.append(w[at])
        docs, hashes = np.concatenate(docs), np.concatenate(hashes)
        order = np.argsort(docs, kind="stable")
        parts = np.split(hashes[order], np.searchsorted(docs[order], np.arange(1, len(texts))))
        return [np.unique(part) for part in parts]


_HITS = "row long, doc_id long, text string, hashes array<long>"


def _hit_side(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, row, wanted = Tokens(), TaskContext.get().partitionId() << 33, sent.value
        for batch in batches:
            for s, e in text_slices(batch, limit=TOGETHER_BYTES):
                at, hashes = [], []
                for k, found in enumerate(wanted.hits_of(texts_of(batch, s, e), tokens)):
                    if len(found):
                        at.append(s + k), hashes.append(found.view(np.int64))
                if at:
                    part = batch.take(pa.array(at))
                    ends = pa.array(np.cumsum([0, *map(len, hashes)]), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hashes)))
                    yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(at)), pa.int64()), part.column(0), part.column(1), lists], names=["row", "doc_id", "text", "hashes"])
                    row += len(at)

    return run


_FOUND = "doc_id long, item_id long, n_tokens long, n_slots long, verbatim boolean"


def _verify_side(sent: Broadcast, keys_only: bool):
    """For documents with their candidate items: what contaminates them, or just the documents' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, texts, known = Tokens(), sent.value, {}

        def item(i: int) -> Item:
            if i not in known:
                if len(known) >= REMEMBERED_ITEMS:
                    known.clear()
                known[i] = Item(i, texts[i], tokens)
            return known[i]

        for batch in batches:
            for s, e in text_slices(batch):
                rows, bad = [], []
                part = batch.slice(s, e - s)
                for k, (doc_id, text, items) in enumerate(zip(part.column(0).to_pylist(), texts_of(batch, s, e), part.column(2).to_pylist(), strict=True)):
                    found = matches(text, Index(map(item, sorted(items))), tokens)
                    rows += [(doc_id, *m) for m in found]
                    if found:
                        bad.append(k)
                if keys_only and bad:
                    yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(bad))], names=["text"])
                elif rows and not keys_only:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[DataFrame]:
    """item_id, text of the benchmark, block by block; a block's text is bounded."""
    own = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    n = pieces(own.agg(F.sum(F.length("text"))).first()[0] or 0, BLOCK_WINDOWS * WINDOW_CHARS, least=1)
    for k in range(n):
        yield own.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)


def _verified(spark: SparkSession, own: DataFrame, block: DataFrame, keys_only: bool) -> DataFrame | None:
    """What one block of the benchmark finds in own(doc_id, text), see _verify_side; None for a block without windows."""
    items = {i: (t or "").encode() for i, t in sorted(tuple(r) for r in block.collect())}
    windows = materialise(spark, block.mapInArrow(_window_side, "hash long, item_id long, shape long"), "benchmark-windows")
    shapes = [r[0] for r in windows.select("shape").distinct().collect()]  # a few window lengths
    hashes = windows.select("hash").distinct().toArrow().column(0).to_numpy()  # bounded by the block
    if not len(hashes):
        return None
    context = spark.sparkContext
    hits = materialise(spark, own.mapInArrow(_hit_side(context.broadcast(_Filter(hashes, shapes))), _HITS), "benchmark-hits")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    left = hits.select("row", F.explode("hashes").alias("hash"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    right = windows.select("hash", "item_id", F.explode(salts).alias("salt"))
    candidates = left.join(right, ["hash", "salt"]).groupBy("row").agg(F.collect_set("item_id").alias("items"))
    met = hits.select("row", "doc_id", "text").join(candidates, "row").select("doc_id", "text", "items")
    return met.mapInArrow(_verify_side(context.broadcast(items), keys_only), "text string" if keys_only else _FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_tokens, n_slots, verbatim: a row for each document and item that contaminates it, no others."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        part = _verified(spark, own, block, keys_only=False)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], _FOUND) if out is None else out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text), F.length(text)]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows; each block of the benchmark filters what the ones before it left.

    Whether a row goes depends on its text alone, so rows without an id and rows that share one are judged alike, and
    repeated rows stay or go together; docs may have columns of any names beside text.
    """
    spark = docs.sparkSession
    for block in _blocks(benchmark, "item_id", "text"):
        bad = _verified(spark, docs.select(F.lit(None).cast("long").alias("doc_id"), F.col("text")), block, keys_only=True)
        if bad is not None:
            keys = materialise(spark, bad.select(*(c.alias(f"key{k}") for k, c in enumerate(_text_key(F.col("text"))))).distinct(), "benchmark-texts")
            same = [mine == keys[f"key{k}"] for k, mine in enumerate(_text_key(docs["text"]))]
            docs = docs.join(keys, same[0] & same[1] & same[2], "left_anti")
    return docs
