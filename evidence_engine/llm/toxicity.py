"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text, labelled or not, is unlabelled. With class prior pi and a loss
l, the risk of a classifier is estimated as pi E_pos[l(+)] + max(0, E_unl[l(-)] - pi E_pos[l(-)]): unlabelled text counts as
clean but for the share of toxic text in it. Where the second term falls below zero, the classifier has begun to learn its
positives by heart, and the step goes up that term instead (Kiryo et al., 2017).

1. The prior is the share of toxic rows among the labels that may be learned from.
2. Up to POSITIVES toxic and UNLABELLED other documents are drawn by a hash of their ids and written down. Spark counts in
   how many of either each feature occurs; features are words and their beginnings, and for scripts without spaces runs of
   two and three letters. The FEATURES with the greatest likelihood ratio for toxic text are kept.
3. Tasks turn the drawn documents into rates of these features. From the rates, of fixed size, MEMBERS numpy classifiers are
   trained on redrawn positives; their mean is the model.
4. One scan scores all documents by their whole texts.

Scores take in nothing but the text. The bounds on what is drawn are those of the fitting alone.

Defined cases: null texts count as empty; a text without letters gets the score of no evidence; labels whose id or mark is
null, and labels of ids that no document has, are ignored; an id with labels of both kinds is toxic; of rows with one id
the least text is learned from, and each is scored by its own; without confirmed toxic text every score is 0; an empty
table gives no rows; bytes that are no UTF-8 read as U+FFFD; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm.common import materialise, table, text_slices, texts_of

#: Bounds on the documents that are drawn for fitting (as expected by the hash), and on features.
POSITIVES, UNLABELLED, FEATURES = 4000, 12000, 1024
#: Positives that must hold a feature, and its least likelihood ratio statistic; of chance features one in 10^5 reaches it.
LEAST_POSITIVES, LEAST_RATIO = 3, 20.0
MEMBERS, EPOCHS, BATCH, POSITIVE_BATCH, RATE, DECAY = 5, 20, 256, 64, 0.1, 1e-3
#: Words that a task remembers the features of, and features that it counts before it passes them on.
REMEMBERED = 100_000
_WORD = re.compile(r"[^\W\d_]+")
#: From here on, scripts write words without spaces between them, or nearly.
_DENSE = "⺀"


class Model(NamedTuple):
    features: dict[str, int]
    scale: np.ndarray
    weights: np.ndarray
    biases: np.ndarray


def features_of(word: str) -> list[str]:
    """The word, its beginnings, and in dense scripts its runs of two and three letters."""
    out = ["=" + word] + ["^" + word[:k] for k in (3, 4, 5, 6) if len(word) > k]
    if any(c >= _DENSE for c in word):
        out += {word[i : i + k] for k in (2, 3) for i in range(len(word) - k + 1)}
    return out


def words_of(text: bytes | None) -> Counter[str]:
    return Counter(_WORD.findall((text or b"").decode("utf-8", "replace").lower()))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, toxic, others: how many of a task's documents of either kind hold each feature."""
    counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

    def rows() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        cols = [pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in counts)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(cols, names=["feature", "toxic", "others"])

    for batch in batches:
        kinds = batch.column(1).to_pylist()
        for start, end in text_slices(batch):
            for toxic, text in zip(kinds[start:end], texts_of(batch, start, end), strict=True):
                counts[0 if toxic else 1].update({f for w in words_of(text) for f in features_of(w)})
                if len(counts[0]) + len(counts[1]) > REMEMBERED:
                    yield rows()
    yield rows()


class Rates:
    """Rates of the model's features in texts: log(1 + occurrences in a hundred words)."""

    def __init__(self, index: dict[str, int]):
        self.index, self.known = index, {}

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """(features, rates) of a text, those that occur."""
        words, held = words_of(text), {}
        for word, n in words.items():
            at = self.known.get(word)
            if at is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                at = self.known[word] = tuple(i for f in features_of(word) if (i := self.index.get(f)) is not None)
            for i in at:
                held[i] = held.get(i, 0) + n
        rates = np.fromiter(held.values(), np.float64, len(held)) * 100 / max(1, words.total())
        return np.fromiter(held.keys(), np.int64, len(held)), np.log1p(rates)


def _rated(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates = Rates(index)
        for batch in batches:
            for start, end in text_slices(batch):
                found = [rates.of(t) for t in texts_of(batch, start, end)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(start, end - start), pa.array([f.tolist() for f, _ in found], pa.list_(pa.int32())), pa.array([r.tolist() for _, r in found], pa.list_(pa.float32())),
                ], names=["toxic", "at", "rate"])

    return run


def training_rows(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """doc_id, toxic, text of the drawn documents, and the class prior.

    labels (doc_id, toxic) are those that may be learned from. One row is kept of each id.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    marked, toxic = marks.agg(F.count("*"), F.count_if("toxic")).first()
    total = docs.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    ids = marks.where(F.col("toxic") & (place < POSITIVES / max(1, toxic))).select("doc_id")
    texts = docs.select("doc_id", "text")
    # At most about POSITIVES ids, so they may travel to the texts.
    positive = texts.join(F.broadcast(ids), "doc_id", "left_semi").withColumn("toxic", F.lit(True))
    unlabelled = texts.where(place < UNLABELLED / max(1, total)).withColumn("toxic", F.lit(False))
    drawn = positive.unionByName(unlabelled).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return materialise(spark, drawn, "toxicity-drawn"), toxic / max(1, marked)


def choose_features(drawn: DataFrame) -> dict[str, int]:
    """The features whose documents are toxic more often than chance allows, by the likelihood ratio of two binomials."""
    toxic, others = drawn.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    held = drawn.select("doc_id", "toxic", "text").mapInArrow(_held, "feature string, toxic long, others long")
    held = held.groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("others").alias("b")).where(F.col("a") >= LEAST_POSITIVES)
    share, chance = F.col("a") / float(max(1, toxic)), F.greatest(F.col("b") / float(max(1, others)), F.lit(1e-9))
    absent = F.when(F.col("a") < toxic, (toxic - F.col("a")) * F.log((1 - share) / F.greatest(1 - chance, F.lit(1e-9)))).otherwise(0.0)
    ratio = 2 * (F.col("a") * F.log(share / chance) + absent)
    best = held.where(share > chance).select("feature", ratio.alias("ratio")).where(F.col("ratio") > LEAST_RATIO)
    return {r.feature: i for i, r in enumerate(best.orderBy(F.desc("ratio"), "feature").limit(FEATURES).collect())}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def learn(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float, int]:
    """Weights and bias of a linear classifier by the non-negative risk with the logistic loss, and how many steps went up
    the clean term; rates of a row are divided by their scale beforehand."""
    rs = np.random.RandomState(seed)
    own = positive[rs.randint(0, len(positive), len(positive))]
    w, b = np.zeros(positive.shape[1]), np.log(prior / (1 - prior))
    seen_w, seen_b, turned = np.full(len(w), 1e-6), 1e-6, 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rs.permutation(len(unlabelled)), max(1, len(unlabelled) // BATCH)):
            xp, xu = own[rs.randint(0, len(own), POSITIVE_BATCH)], unlabelled[rows]
            zp, zu = xp @ w + b, xu @ w + b
            clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if clean >= 0:
                gp, gu = np.full(len(xp), -prior / len(xp)), _sigmoid(zu) / len(xu)
            else:
                gp, gu, turned = prior * _sigmoid(zp) / len(xp), -_sigmoid(zu) / len(xu), turned + 1
            gw, gb = gp @ xp + gu @ xu + DECAY * w, gp.sum() + gu.sum()
            seen_w += gw * gw
            seen_b += gb * gb
            w = w - RATE * gw / np.sqrt(seen_w)
            b = b - RATE * gb / np.sqrt(seen_b)
    return w, float(b), turned


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of docs (doc_id, text) and labels (doc_id, toxic); None without confirmed toxic text."""
    drawn, prior = training_rows(spark, docs, labels)
    index = choose_features(drawn)
    # (POSITIVES + UNLABELLED) rows of up to FEATURES floats.
    rows = drawn.select("doc_id", "toxic", "text").mapInArrow(_rated(index), "toxic boolean, at array<int>, rate array<float>").toArrow()
    toxic = np.asarray(rows.column("toxic").combine_chunks(), dtype=bool) if rows.num_rows else np.zeros(0, bool)
    if not toxic.any() or toxic.all() or prior <= 0:
        return None
    x = np.zeros((len(toxic), len(index)), np.float32)
    for k, (at, rate) in enumerate(zip(rows.column("at").to_pylist(), rows.column("rate").to_pylist(), strict=True)):
        x[k, at] = rate
    # Tasks finish in any order, and ties of a sort have none: order rows by what they hold.
    order = np.lexsort(np.c_[x, toxic].T)
    x, toxic = x[order], toxic[order]
    scale = np.sqrt((x[toxic].astype(np.float64) ** 2).mean(axis=0)) + 1e-9
    x /= scale
    prior = min(prior, 0.9)
    members = [learn(x[toxic].astype(np.float64), x[~toxic], prior, seed) for seed in range(MEMBERS)]
    return Model(index, scale, np.array([m[0] for m in members]), np.array([m[1] for m in members]))


def _scoring(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates = Rates(model.features if model else {})
        for batch in batches:
            for start, end in text_slices(batch):
                scores = np.zeros(end - start)
                for k, text in enumerate(texts_of(batch, start, end) if model else ()):
                    at, rate = rates.of(text)
                    scores[k] = _sigmoid(model.weights[:, at] @ (rate / model.scale[at]) + model.biases).mean()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(scores)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier toxic) of every row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scoring(model), f"doc_id {kind}, score double")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fifth = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    scored = score(docs, train(spark, docs, labels.where(fifth != 0)))
    held_out = F.coalesce(fifth == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
