"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters. Its features are hashed: the word itself (lexicon), its prefixes and suffixes (n-grams that
touch a word boundary) and its inner 2- and 3-grams. Labels are the languages of the training rows; transitions between
the labels of neighbouring words are learned, so a text may switch language within a line. Forward-backward over the
whole text gives each word's label probabilities; the text's language is the one of the greatest expected number of
words, its score the share of those.

Training draws a bounded sample of labelled rows (about SAMPLE_ROWS for each language, and of those up to SAMPLE_BYTES
of text, whole rows by the order of a hash) and mixes stretches of different rows into code-switched sequences.
Prediction reads whole texts: a slice of texts is one chain in which every text restarts, cut into blocks whose transfer
matrices are multiplied, so it is exact for texts of any length and runs in numpy. Of a long text, features are held for
a piece at a time, messages for a run of blocks, and only each word's scores throughout.

Defined cases: a null text, or one without a letter: `und`, score 0; no labelled rows: `und`; ties go to the language
that sorts first; a null id is no training row and not held out; bytes that are no UTF-8 are read as U+FFFD, which is no
letter; equal hashes of the sample are in the order of their texts; repeated rows each get their row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_engine.llm.common import mix, table, text_slices, texts_of

#: The training sample's bounds for each language, and the hashed features.
SAMPLE_ROWS, SAMPLE_BYTES, HASHED = 400, 600_000, 1 << 18
UNKNOWN = "und"
_BASE = np.uint64(0x100000001B3)
#: Words of a block, blocks whose messages are held at once, and characters whose features are.
_BLOCK, _BLOCKS, _PIECE = 48, 2048, 250_000
#: Bytes of the texts that make one chain.
SLICE = 250_000


class Model(NamedTuple):
    """labels; emissions[feature, label]; transitions[from, to] and start[label] as logarithms."""

    labels: list[str]
    emissions: np.ndarray
    transitions: np.ndarray
    start: np.ndarray


_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and its lower-case letter."""
    if not _tables:
        # One character at a time: lists of all of Unicode's would stay with the worker.
        low = np.arange(0x110000, dtype=np.uint32)
        alpha = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        for c in np.flatnonzero(alpha).tolist():
            one = chr(c).lower()
            if len(one) == 1:
                low[c] = ord(one)
        _tables.extend([alpha, low])
    return _tables[0], _tables[1]


class Words(NamedTuple):
    """The words of some texts: hashed features of all, where each word's begin, and each word's text."""

    slots: np.ndarray
    first: np.ndarray
    text: np.ndarray


def words_of(texts: list[str]) -> Words:
    alpha, lower = _letters()
    joined = " ".join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    letter = alpha[points]
    c = np.where(letter, lower[points], 0).astype(np.uint64)
    step = np.diff(letter.astype(np.int8))
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    # n-grams that begin at each place; a boundary reads as 0.
    two = mix(c[:-1] * _BASE + c[1:] + np.uint64(2))
    three = mix((c[:-2] * _BASE + c[1:-1]) * _BASE + c[2:] + np.uint64(3) * _BASE)
    size = end - start
    # Whole words: sums of mixed letters times powers by place.
    place = np.arange(len(c)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(c)]))
    sums = np.cumsum(mix(c + np.uint64(0x9E3779B97F4A7C15) * (place.astype(np.uint64) + np.uint64(1))))
    whole = mix(sums[end - 1] - sums[start - 1])
    # Features of a word: 2-grams from the boundary before it on, as many 3-grams but one, the 4-grams at both ends, itself.
    each = 2 * size + 4
    first = np.cumsum(each) - each
    slots = np.empty(int(each.sum()), np.uint64)
    within = lambda n: np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    n2, n3 = size + 1, size
    k2, k3 = within(n2), within(n3)
    slots[np.repeat(first, n2) + k2] = two[np.repeat(start - 1, n2) + k2]
    slots[np.repeat(first + n2, n3) + k3] = three[np.repeat(start - 1, n3) + k3]
    tail = first + n2 + n3
    slots[tail] = whole
    # The 4-grams stay within the word, so a word's features are its own whatever stands next to it.
    third = np.where(size > 2, c[np.minimum(start + 2, len(c) - 1)], np.uint64(0))
    fore = np.where(size > 2, c[np.maximum(end - 3, 0)], np.uint64(0))
    slots[tail + 1] = mix(three[start - 1] * _BASE + third)
    slots[tail + 2] = mix(three[end - 2] * _BASE + fore + np.uint64(1))
    bounds = np.cumsum([1 + len(t) for t in texts])
    return Words((slots & np.uint64(HASHED - 1)).astype(np.int64), first, np.searchsorted(bounds, start, side="right"))


def _emit(words: Words, emissions: np.ndarray) -> np.ndarray:
    return np.add.reduceat(emissions[words.slots], words.first, axis=0) if len(words.first) else np.zeros((0, emissions.shape[1]))


class _Chain:
    """One chain of words (score by label) that restarts where told, in blocks; messages are each scaled for themselves."""

    def __init__(self, scores: np.ndarray, restart: np.ndarray, transitions: np.ndarray, start: np.ndarray):
        self.n, self.k = scores.shape
        self.a, self.begin = np.exp(transitions - transitions.max()), np.exp(start - start.max())
        self.scores, self.restart = scores, restart
        self.blocks = -(-self.n // _BLOCK)
        self._between()

    def _run(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Emissions and restarts of some blocks; padding restarts, so nothing comes back from it."""
        rows = slice(first * _BLOCK, min(last * _BLOCK, self.n))
        s = self.scores[rows].astype(np.float64)
        pad = (last - first) * _BLOCK - len(s)
        e = np.concatenate([np.exp(s - s.max(axis=1, keepdims=True)), np.ones((pad, self.k))])
        r = np.concatenate([self.restart[rows], np.ones(pad, bool)])
        return e.reshape(-1, _BLOCK, self.k), r.reshape(-1, _BLOCK)

    def _spans(self) -> Iterator[tuple[int, int]]:
        for first in range(0, self.blocks, _BLOCKS):
            yield first, min(first + _BLOCKS, self.blocks)

    def _between(self) -> None:
        """The messages into and out of each block, by the transfer matrices of whole blocks."""
        k, reset = self.k, np.ones((self.k, 1)) * self.begin
        transfer = np.empty((self.blocks, k, k))
        for first, last in self._spans():
            e, r = self._run(first, last)
            prod = np.broadcast_to(np.eye(k), (last - first, k, k)).copy()
            for t in range(_BLOCK):
                nxt = (prod.reshape(-1, k) @ self.a).reshape(-1, k, k)
                at = np.flatnonzero(r[:, t])
                if len(at):
                    nxt[at] = prod[at] @ reset
                prod = nxt * e[:, t, None, :]
                prod /= prod.max(axis=(1, 2), keepdims=True)
            transfer[first:last] = prod
        self.into, self.out_of = np.empty((self.blocks, k)), np.empty((self.blocks, k))
        v = self.begin
        for b in range(self.blocks):
            self.into[b] = v
            v = v @ transfer[b]
            v = v / v.max()
        v = np.ones(k)
        for b in range(self.blocks - 1, -1, -1):
            self.out_of[b] = v
            v = transfer[b] @ v
            v = v / v.max()

    def messages(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Emissions, forward and backward messages of the words in order, for a run of blocks at a time."""
        for first, last in self._spans():
            e, r = self._run(first, last)
            alpha, beta = np.empty_like(e), np.empty_like(e)
            v = self.into[first:last]
            for t in range(_BLOCK):
                v = np.where(r[:, t, None], v.sum(axis=1, keepdims=True) * self.begin, v @ self.a) * e[:, t]
                v = v / v.max(axis=1, keepdims=True)
                alpha[:, t] = v
            v = self.out_of[first:last]
            for t in range(_BLOCK - 1, -1, -1):
                beta[:, t] = v
                w = e[:, t] * v
                v = np.where(r[:, t, None], (w @ self.begin)[:, None], w @ self.a.T)
                v = v / v.max(axis=1, keepdims=True)
            n = min(last * _BLOCK, self.n) - first * _BLOCK
            yield tuple(x.reshape(-1, self.k)[:n] for x in (e, alpha, beta))


def forward_backward(scores: np.ndarray, restart: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions, forward and backward messages of a whole chain."""
    parts = list(_Chain(scores, restart, transitions, start).messages())
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def posteriors(scores: np.ndarray, restart: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of each word."""
    _, alpha, beta = forward_backward(scores, restart, transitions, start)
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 0.2, decay: float = 1e-4, seed: int = 1) -> Model | None:
    """Gradient ascent (Adagrad) on the likelihood of code-switched sequences made from (language, text) rows."""
    labels = sorted({lang for lang, _ in rows})
    stretches: list[tuple[int, str]] = []
    rng = random.Random(seed)
    for lang, text in sorted(rows):
        parts = text.split()
        i = 0
        while i < len(parts):
            n = rng.randint(4, 40)
            stretches.append((labels.index(lang), " ".join(parts[i : i + n])))
            i += n
    if not labels:
        return None
    k = len(labels)
    model = Model(labels, np.zeros((HASHED, k)), np.zeros((k, k)), np.zeros(k))
    past = [np.full(x.shape, 1e-6) for x in model[1:]]
    for _ in range(epochs):
        rng.shuffle(stretches)
        for s in range(0, len(stretches), 256):
            part = stretches[s : s + 256]
            words = words_of([t for _, t in part])
            if not len(words.first):
                continue
            gold = np.array([y for y, _ in part])[words.text]
            # Two or three stretches make a sequence.
            chain = words.text // rng.choice([2, 3])
            restart = np.r_[True, chain[1:] != chain[:-1]]
            e, alpha, beta = forward_backward(_emit(words, model.emissions), restart, model.transitions, model.start)
            p = alpha * beta
            diff = np.eye(k)[gold] - p / p.sum(axis=1, keepdims=True)
            inner = np.flatnonzero(~restart)
            pair = alpha[inner - 1][:, :, None] * np.exp(model.transitions - model.transitions.max()) * (e * beta)[inner][:, None, :]
            grad_t = -(pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            np.add.at(grad_t, (gold[inner - 1], gold[inner]), 1)
            used, at = np.unique(words.slots, return_inverse=True)
            each = np.repeat(diff, np.diff(np.r_[words.first, len(words.slots)]), axis=0)
            grad_e = np.stack([np.bincount(at, each[:, y], len(used)) for y in range(k)], axis=1)
            for x, rows_of, g, h in zip(model[1:], (used, slice(None), slice(None)), (grad_e, grad_t, diff[restart].sum(axis=0)), past, strict=True):
                step = g - decay * x[rows_of]
                h[rows_of] += step**2
                x[rows_of] += rate * step / np.sqrt(h[rows_of])
    return model


_NO_LETTER = re.compile(r"[\W\d_]")


def _letter_pieces(text: str) -> Iterator[str]:
    """A text in pieces of about _PIECE characters, cut at a character that is no letter, so no word is cut."""
    at = 0
    while len(text) - at > _PIECE:
        m = _NO_LETTER.search(text, at + _PIECE)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def _scored(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scores by label of each word, and each word's text."""
    if sum(map(len, texts)) <= 2 * _PIECE:
        words = words_of(texts)
        return _emit(words, model.emissions), words.text
    scores, owner = [], []
    for k, text in enumerate(texts):
        for part in _letter_pieces(text):
            scores.append(_emit(words_of([part]), model.emissions))
            owner.append(np.full(len(scores[-1]), k))
    return np.concatenate(scores), np.concatenate(owner)


def predict(model: Model | None, texts: list[str]) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    out = [(UNKNOWN, 0.0)] * len(texts)
    if model is None:
        return out
    scores, owner = _scored(model, texts)
    if not len(owner):
        return out
    restart = np.r_[True, owner[1:] != owner[:-1]]
    mass, at = np.zeros((len(texts), len(model.labels))), 0
    for _, alpha, beta in _Chain(scores, restart, model.transitions, model.start).messages():
        p = alpha * beta
        p /= p.sum(axis=1, keepdims=True)
        own = owner[at : at + len(p)]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        mass[own[first]] += np.add.reduceat(p, first, axis=0)
        at += len(p)
    start = owner[np.flatnonzero(restart)]
    share = mass[start] / mass[start].sum(axis=1, keepdims=True)
    best = np.round(share, 12).argmax(axis=1)
    for i, b, s in zip(start.tolist(), best.tolist(), share[np.arange(len(best)), best].tolist(), strict=True):
        out[i] = model.labels[b], min(1.0, s)
    return out


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """About `rows` rows of each language, drawn by a hash of the id; of these, in the hash's order, whole texts of about
    `most_bytes` in all for a language, and one row of each at least.

    What is collected is bounded by both, but for the one row that passes the bound.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return []
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, rows / n)))))
    drawn = known.select("lang", "text", hashed.alias("draw"), F.length(F.col("text").cast("binary")).alias("size")).where(F.col("draw") / float(1 << 40) < share[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("draw", "text")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = drawn.withColumn("before", before).where(F.col("before") < most_bytes)
    return [tuple(r) for r in kept.select("lang", "text").collect()]


def _predict_side(model: Model | None):
    compact = model and model._replace(emissions=model.emissions.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in text_slices(batch, limit=SLICE):
                got = predict(compact, [(x or b"").decode("utf-8", "replace") for x in texts_of(batch, s, e)])
                part = batch.slice(s, e - s)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only the text is read by the model."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out(F.col("doc_id")).alias("held_out"), "text")
    return own.mapInArrow(_predict_side(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(training_sample(docs)))


#: The pipeline's stage rejects texts without a letter and those whose main language has less than this share. It is
#: low on purpose: a short text that is half a license line or a key keeps its place.
STAGE_SCORE = 0.3


def _keep_side(model: Model | None):
    compact = model and model._replace(emissions=model.emissions.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in text_slices(batch, limit=SLICE):
                got = predict(compact, [(x or b"").decode("utf-8", "replace") for x in texts_of(batch, s, e)])
                yield batch.slice(s, e - s).filter(pa.array([lang != UNKNOWN and score >= STAGE_SCORE for lang, score in got], pa.bool_()))

    return run


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the rows whose language can't be told: no letter, or no language with STAGE_SCORE of the words."""
    return docs.mapInArrow(_keep_side(train(training_sample(docs))), docs.schema)
