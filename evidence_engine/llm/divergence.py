"""Source divergence audit by a two-pass vocabulary automaton.

Terms are runs of letters A-Z (lower-cased), a-z and of anything from U+0080 on. Each task packs its texts, reduced to
their terms, into blocks of one language and of bounded size, which are written down compressed.

1. Each block lists its terms with the number of its documents that hold them. Summed up by language these are exact
   document frequencies, and the terms of LEAST_DOCUMENTS or more are the language's vocabulary.
2. A block gets back those of its own terms that were not kept, which are fewer, makes an Aho-Corasick automaton of the
   others, padded by delimiters, and recounts their occurrences by source. An automaton so holds no more than its block's
   texts, however large the vocabulary is, and nothing is broadcast.

The counts are postings (lang, term, source). With p = 1 + floor(10^9 (count + 1) / (N + V)), a pair's value is a sum over
the whole vocabulary, but all terms that a source lacks have one p. So with p0, q0 for absent terms and
f(p, q) = floor((p - q)^2 / q), the sum over V terms is

    V f(p0, q0)  +  sum over the source's terms of  f(p, q0) - f(p0, q0)  +  sum over the other's  f(p0, q) - f(p0, q0)
    +  sum over common terms of  f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0):

the first two lines need only how often each p occurs in a source, the last one is a join of postings. As all p - 1 of a
group sum up to at most 10^9, no sum of f exceeds 4 * 10^18: everything is exact in longs.

Defined cases: null text, lang and source read as ''; texts without terms still make their group occur; a language with no
kept term gives pairs of value 0 and no term; repeated rows are documents of their own; bytes that are no UTF-8 read as
U+FFFD; ties rank by the item's bytes; an empty table gives no rows; other columns are ignored, whatever their names.
Doubling texts doubles the work: nothing but the table of groups and pairs, which are the result, grows with sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_engine.llm.common import discard, free_shuffles, materialise, pieces, plan_bytes, table, tasks_for, text_slices, texts_of

#: Documents of a language that must hold a term for it to be kept, and ranks of terms that are reported.
LEAST_DOCUMENTS, TOP_TERMS = 3, 200
#: Bytes of text of a block, and sources of a language up to which a term's postings meet in one task.
BLOCK_BYTES, SOURCES_EACH = 8 << 20, 1024
#: Each byte as a letter of a term or as the delimiter.
_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
#: Between a source's documents and between sources; no term holds them.
_DOCUMENT, _SOURCE = b"\n", b"\x00"
_PACKED = "block long, lang string, sources array<string>, packed binary, terms binary, documents binary"
_value = itemgetter(1)


def _terms(text: bytes | None) -> list[bytes]:
    """The text's terms, in order."""
    text = text or b""
    try:
        text.decode()
    except UnicodeDecodeError:
        text = text.decode("utf-8", "replace").encode()
    return text.translate(_LETTERS).split()


def _packing(block_bytes: int):
    """Rows of _PACKED from (lang, source, text): a task's texts by language, a row as soon as they make up a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        held: dict[str, tuple[dict[str, list[bytes]], list[int], Counter[bytes]]] = {}
        total, number = 0, TaskContext.get().partitionId() << 32

        def block(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            by, _, seen = held.pop(lang)
            packed = zstandard.compress(_SOURCE.join(_DOCUMENT.join(texts) for texts in by.values()), 3)
            terms = zstandard.compress(b" ".join(seen), 3)
            documents = zstandard.compress(np.fromiter(seen.values(), np.int64, len(seen)).tobytes(), 3)
            cols = [pa.array([number]), pa.array([lang]), pa.array([list(by)], pa.list_(pa.string())), *(pa.array([x], pa.binary()) for x in (packed, terms, documents))]
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _PACKED.split(", ")])

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in text_slices(batch):
                for lang, source, text in zip(langs[start:end], sources[start:end], texts_of(batch, start, end), strict=True):
                    if terms := _terms(text):
                        text = b" ".join(terms)
                        by, size, seen = held.setdefault(lang, ({}, [0], Counter()))
                        by.setdefault(source, []).append(text)
                        seen.update(set(terms))
                        size[0] += len(text)
                        total += len(text)
                        if size[0] >= block_bytes:
                            total -= size[0]
                            yield block(lang)
                        elif total >= 4 * block_bytes:
                            total = 0
                            for other in list(held):
                                yield block(other)
        for lang in list(held):
            yield block(lang)

    return run


def _sections(packed: bytes) -> list[list[bytes]]:
    """The documents of each source of a block."""
    import zstandard

    return [part.split(_DOCUMENT) for part in zstandard.decompress(packed).split(_SOURCE)]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, lang, term, documents: the terms of each block and how many of its documents hold them."""
    import zstandard

    for batch in batches:
        for block, lang, terms, documents in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held = np.frombuffer(zstandard.decompress(documents), np.int64)
            n = len(held)
            terms = pa.array(zstandard.decompress(terms).split(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array([lang] * n, pa.string()), terms, pa.array(held)], names=["block", "lang", "term", "documents"])


def _counted(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers below n, and how often each is there: by a table, or by sorting where a table would be mostly empty."""
    if 8 * len(at) < n:
        return np.unique(at, return_counts=True)
    count = np.bincount(at, minlength=n)
    found = np.flatnonzero(count)
    return found, count[found]


def _recounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, count: occurrences of a block's kept terms, found by an automaton over the padded terms."""
    import ahocorasick
    import zstandard

    for batch in batches:
        for lang, sources, packed, terms, rare in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rare = {x.encode() for x in rare or ()}
            kept = [x for x in zstandard.decompress(terms).split() if x not in rare]
            if not kept:
                continue
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, term in enumerate(kept):
                automaton.add_word(f" {term.decode('latin-1')} ", i)
            automaton.make_automaton()
            terms = pa.array(kept, pa.binary()).cast(pa.string())
            for source, texts in zip(sources, _sections(packed), strict=True):
                # One character a byte; neighbours share a delimiter, which the automaton's overlapping matches allow.
                line = b" ".join([b"", *texts, b""]).decode("latin-1")
                at, count = _counted(np.fromiter(map(_value, automaton.iter(line)), np.int64), len(kept))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), terms.take(pa.array(at)), pa.array(count, pa.int64())], names=["lang", "source", "term", "count"])


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / total), by long division three digits at a time, so no product leaves the longs."""
    left = count + 1
    out = _div(left, total)
    for _ in range(3):
        left = (left % total) * 1000
        out = out * 1000 + _div(left, total)
    return out + 1


def _gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def term_counts(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCUMENTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, source, term, count of the kept terms of docs (lang, source, text), where the count isn't 0."""
    empty = F.lit("")
    size = plan_bytes(docs.select("text"))
    tasks = tasks_for(spark, size)
    blocks = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), "text").where(F.col("text").isNotNull())
    blocks = materialise(spark, blocks.mapInArrow(_packing(block_bytes), _PACKED), "divergence-blocks")
    listed = blocks.select("block", "lang", "terms", "documents").mapInArrow(_listed, "block long, lang string, term string, documents long").repartition(tasks, "lang", "term")
    # A term has one row a block, so no term is many rows.
    if least <= 3:
        # A term of two documents at most is in two blocks at most: its first and its last.
        rare = listed.groupBy("lang", "term").agg(F.sum("documents").alias("n"), F.min("block").alias("first"), F.max("block").alias("last")).where(F.col("n") < least)
        rare = rare.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("block"), "term")
    else:
        rare = listed.withColumn("n", F.sum("documents").over(Window.partitionBy("lang", "term"))).where(F.col("n") < least).select("block", "term")
    # Blocks meet their terms in tasks of one or two blocks each, as a row holds a whole block.
    each = pieces(2 * size, block_bytes, least=tasks)
    rare = rare.repartition(each, "block").groupBy("block").agg(F.collect_list("term").alias("rare"))
    met = blocks.drop("documents").repartition(each, "block").join(rare.hint("shuffle_merge"), "block", "left")
    counts = met.select("lang", "sources", "packed", "terms", "rare").mapInArrow(_recounted, "lang string, source string, term string, count long")
    counts = counts.repartition(tasks, "lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))
    postings = materialise(spark, counts, "divergence-postings")
    discard(spark, blocks)
    free_shuffles(spark)
    return postings


def _pairs(groups: DataFrame, postings: DataFrame, salts: int) -> DataFrame:
    """lang, source, item, value of all pairs of a language's sources.

    groups: lang, source, size (V), p0; postings: lang, term, source, p, p0. Common terms are joined once for both
    directions, a source's terms by the distinct values of p.
    """
    p, q, p0, q0 = (F.col(x) for x in ("p", "q", "p0", "q0"))
    keys = ["lang", "term"]
    a = b = postings.select("lang", "term", "source", "p", "p0")
    if salts > 1:
        keys.append("salt")
        a = a.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(salts)))
        b = b.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    a, b = a.alias("a"), b.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    met = a.join(b, [*same, F.col("a.source") < F.col("b.source")]).select(
        "a.lang", "a.source", F.col("b.source").alias("item"), "a.p", "a.p0", F.col("b.p").alias("q"), F.col("b.p0").alias("q0"))
    beyond = lambda p, p0, q, q0: _gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0)
    common = met.groupBy("lang", "source", "item").agg(F.sum(beyond(p, p0, q, q0)).alias("there"), F.sum(beyond(q, q0, p, p0)).alias("back"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    values = postings.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    single = values.join(other, "lang").where(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(
        F.sum(F.col("n") * (_gap(p, q0) - _gap(p0, q0))).alias("there"), F.sum(F.col("n") * (_gap(q0, p) - _gap(q0, p0))).alias("back"))
    base = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    exact = lambda x: F.col(x).cast("decimal(38,0)").alias("value")
    both = common.unionByName(single)
    parts = base.select("lang", "source", "item", F.when(F.col("size") > 0, F.col("size") * _gap(p0, q0)).otherwise(0).cast("decimal(38,0)").alias("value"))
    parts = parts.unionByName(both.select("lang", "source", "item", exact("there")))
    parts = parts.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), exact("back")))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def divergence(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: each source against the language's other sources (part `pair`), and the terms
    that it has more of than the language, by their share of the divergence (part `term`)."""
    counts = term_counts(spark, docs, least, block_bytes)
    empty = F.lit("")
    sizes = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("size"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source")).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "size"])
    # A language without terms has no shares; 1 stands in, and nothing is multiplied by it.
    denominator = F.greatest(F.col("total") + F.col("size"), F.lit(1))
    groups = materialise(spark, groups.withColumn("p0", _share(F.lit(0).cast("long"), denominator)), "divergence-groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    postings = counts.join(groups, ["lang", "source"]).select("lang", "term", "source", "count", _share(F.col("count"), denominator).alias("p"), "p0")
    postings = materialise(spark, postings, "divergence-shares")

    pairs = _pairs(groups, postings, pieces(most, SOURCES_EACH, least=1)).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    langs = groups.groupBy("lang").agg((F.sum("total") + F.max("size")).alias("denominator"))
    whole = postings.groupBy("lang", "term").agg(F.sum("count").alias("all")).join(langs, "lang").select(
        "lang", "term", _share(F.col("all"), F.col("denominator")).alias("q"))
    terms = postings.join(whole, ["lang", "term"]).where(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(w)
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark, table(spark, sf_dir, "documents"))
