"""Edit-aware token counts.

A document's leaves are its stretches of white space with the run of other characters behind them. The tokenizer's
pattern never carries a pre-token from a character that isn't white space over to one that is, so leaves are encoded
apart and their counts add up. A tree keeps, for blocks of leaves, the characters and tokens, and above them the
subtree sums. An edit (start, end, replacement, in code points of the text as it then is) touches the leaves from the
one that holds the character before it to the one that holds the character after it; only these are encoded again, and
the sums on the way up are updated.

Trees are stored as a table (doc_id, text, leaf_chars, leaf_tokens; build_trees), so later edits need no second encoding
(recount). Where no tree is stored yet, count_edited builds and edits in one pass.

Defined cases: a null text is an empty one of no tokens; positions beyond the text are taken as its end, a null start
as 0, a null end as the start, a null replacement as nothing; no edits: the count stays; repeated ids are rows of their
own; bytes that are no UTF-8 are read as U+FFFD; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm.common import table, text_slices, texts_of

#: Leaves of a block; leaves that a worker remembers, and the characters that one of those has at most, so the memory of
#: the memo is bounded in bytes: longer leaves are encoded whenever they are met.
BLOCK_LEAVES, REMEMBERED, LEAF_CHARS = 64, 200_000, 48
#: White space of the tokenizer's pattern (Unicode's White_Space).
_WS = "\t-\r \x85\xa0  -     　"
_LEAF = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: Where a leaf ends and another begins; long texts are cut there into pieces of about so many characters.
_LEAF_END, PIECE = re.compile(f"[^{_WS}](?=[{_WS}])"), 1 << 20
TREES = "doc_id long, text string, leaf_chars binary, leaf_tokens binary"
COUNTS = "doc_id long, n_tokens long, n_tokens_after long, n_leaves long, n_edits long, n_encoded_again long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class LeafCounts(dict):
    """leaf -> number of tokens, remembered."""

    def __init__(self, path: str, most: int = REMEMBERED):
        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most = most

    def __missing__(self, leaf: str) -> int:
        n = len(self.encode(leaf))
        if len(leaf) <= LEAF_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[leaf] = n
        return n

    def of(self, leaves: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, leaves), np.int32, len(leaves))


def leaves_of(text: str, count: LeafCounts) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each leaf; only a piece's leaves are held as strings at a time."""
    chars, tokens, at = [], [], 0
    while at < len(text) or not chars:
        end = _LEAF_END.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = end.end() if end else len(text)
        leaves = _LEAF.findall(text, at, end)
        chars.append(np.fromiter(map(len, leaves), np.int32, len(leaves)))
        tokens.append(count.of(leaves))
        at = end
    return (chars[0], tokens[0]) if len(chars) == 1 else (np.concatenate(chars), np.concatenate(tokens))


class PreTokenTree:
    """Sums of characters and tokens over blocks of leaves, with subtree sums above them."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        cuts = range(BLOCK_LEAVES, len(chars), BLOCK_LEAVES)
        self.blocks = list(zip(np.split(chars, list(cuts)), np.split(tokens, list(cuts)), strict=True))
        self.width = 1 << max(0, (len(self.blocks) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        for i, (c, t) in enumerate(self.blocks):
            self.sums[self.width + i] = c.sum(), t.sum()
        for i in range(self.width - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def _find(self, pos: int) -> tuple[int, int]:
        """The block that holds the character at pos, and the characters before the block."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if before + self.sums[i, 0] <= pos:
                before += int(self.sums[i, 0])
                i += 1
        return min(i - self.width, len(self.blocks) - 1), before

    def _set(self, b: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.blocks[b] = chars, tokens
        i = b + self.width
        self.sums[i] = chars.sum(), tokens.sum()
        while i > 1:
            i //= 2
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    def edit(self, text: str, start: int, end: int, put: str, count: LeafCounts) -> tuple[str, int]:
        """The text after the edit, and how many leaves were encoded again."""
        n = len(text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        after = text[:start] + put + text[end:]
        b1, before = self._find(max(start - 1, 0))
        b2, before2 = self._find(min(end, max(n - 1, 0)))
        chars = np.concatenate([self.blocks[b][0] for b in range(b1, b2 + 1)])
        tokens = np.concatenate([self.blocks[b][1] for b in range(b1, b2 + 1)])
        ends = before + np.cumsum(chars)
        # Leaves from the one with the character before the edit to the one with the character after it.
        i = int(np.searchsorted(ends, max(start - 1, 0), side="right"))
        j = int(np.searchsorted(ends, end, side="right")) + 1
        i, j = min(i, len(chars)), min(j, len(chars))
        left = int(ends[i - 1]) if i else before
        right = int(ends[j - 1]) if j else before
        leaves = _LEAF.findall(text[left:start] + put + text[end : max(right, end)])
        new_chars = np.concatenate([chars[:i], np.array([len(x) for x in leaves], chars.dtype), chars[j:]])
        new_tokens = np.concatenate([tokens[:i], count.of(leaves), tokens[j:]])
        for b in range(b1 + 1, b2 + 1):
            self._set(b, chars[:0], tokens[:0])
        self._set(b1, new_chars, new_tokens)
        return after, len(leaves)


def _tree_side(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = LeafCounts(path)
        for batch in batches:
            for s, e in text_slices(batch):
                texts = [(x or b"").decode("utf-8", "replace") for x in texts_of(batch, s, e)]
                chars, tokens = [], []
                for x in texts:
                    c, t = leaves_of(x, count)
                    chars.append(c.tobytes()), tokens.append(t.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(texts, pa.string()), pa.array(chars, pa.binary()), pa.array(tokens, pa.binary())], names=["doc_id", "text", "leaf_chars", "leaf_tokens"])

    return run


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, text, leaf_chars, leaf_tokens (int32 each): what a document's tree is rebuilt from."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_tree_side(vocabulary or default_vocabulary()), TREES)


def _edited(tree: PreTokenTree, text: str, edits: list[dict | None] | None, count: LeafCounts) -> tuple[str, int]:
    """The text after its edits, one after the other, and how many leaves were encoded again; the tree follows."""
    again = 0
    for x in edits or ():
        if x is not None:
            start = x["start"] or 0
            text, k = tree.edit(text, start, start if x["end"] is None else x["end"], x["put"] or "", count)
            again += k
    return text, again


def _counts_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in COUNTS.split(", ")])


def _edit_side(path: str, texts_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = LeafCounts(path)
        for batch in batches:
            for s, e in text_slices(batch):
                rows, trees, kept = [], [], []
                part = batch.slice(s, e - s)
                for doc_id, text, chars, tokens, edits in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                    tree = PreTokenTree(np.frombuffer(chars or b"", np.int32), np.frombuffer(tokens or b"", np.int32))
                    first = tree.n_tokens
                    text, again = _edited(tree, text or "", edits, count)
                    rows.append((doc_id, first, tree.n_tokens, len(chars or b"") // 4, len(edits or ()), again))
                    if texts_out:
                        kept.append(text)
                        trees.append([np.concatenate([b[k] for b in tree.blocks]).tobytes() for k in (0, 1)])
                if texts_out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(kept, pa.string()), pa.array([x[0] for x in trees], pa.binary()), pa.array([x[1] for x in trees], pa.binary())], names=["doc_id", "text", "leaf_chars", "leaf_tokens"])
                else:
                    yield _counts_batch(rows)

    return run


def _build_and_edit_side(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = LeafCounts(path)
        for batch in batches:
            for s, e in text_slices(batch):
                rows = []
                part = batch.slice(s, e - s)
                for doc_id, raw, edits in zip(part.column(0).to_pylist(), texts_of(batch, s, e), part.column(2).to_pylist(), strict=True):
                    text = (raw or b"").decode("utf-8", "replace")
                    chars, tokens = leaves_of(text, count)
                    tree = PreTokenTree(chars, tokens)
                    first, n_leaves = tree.n_tokens, len(chars)
                    _, again = _edited(tree, text, edits, count)
                    rows.append((doc_id, first, tree.n_tokens, n_leaves, len(edits or ()), again))
                yield _counts_batch(rows)

    return run


def recount(trees: DataFrame, edits: str = "edits", vocabulary: str | None = None, trees_out: bool = False) -> DataFrame:
    """Token counts of trees before and after their edits (array of struct<start, end, put>), or the trees after them."""
    own = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", F.col(edits).cast("array<struct<start:bigint,end:bigint,put:string>>"))
    return own.mapInArrow(_edit_side(vocabulary or default_vocabulary(), trees_out), TREES if trees_out else COUNTS)


def count_edited(docs: DataFrame, edits: str = "edits", id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Token counts of documents before and after their edits, for documents without a stored tree.

    The tree is built and edited in one pass of one Python worker, so neither texts nor trees go back to the JVM.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(edits).cast("array<struct<start:bigint,end:bigint,put:string>>").alias("edits"))
    return own.mapInArrow(_build_and_edit_side(vocabulary or default_vocabulary()), COUNTS)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits: a line put in at a third, 20 characters of the middle
    replaced, the last 10 taken off."""
    n = F.length(F.coalesce("text", F.lit("")))
    third, half = (n / 3).cast("long"), (n / 2).cast("long")
    edit = lambda a, b, put: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(put).alias("put"))
    line = "\nRevised edition, 2nd printing.\n"
    size = n + len(line)  # of the text after the first edit
    edits = F.array(edit(third, third, line), edit(half + len(line), F.least(half + len(line) + 20, size), "[a word's gone]"), edit(n + F.lit(len(line) - 15), n + 2 * 10**9, ""))
    return count_edited(table(spark, sf_dir, "documents").withColumn("edits", edits))
