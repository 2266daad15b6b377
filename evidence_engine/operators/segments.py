"""Texts into blocks and paragraphs by window functions over their lines: gaps and islands, no Python.

A document's lines lie in one window partition, ordered by place, after one exchange of whole texts; windows spill, so a
very long document needs no more memory than a short one until its text is joined again. Lines of short texts take many
times the room of the files that they come from, so this exchange has partitions by the files' bytes (PART_BYTES): Spark's own
would be sized by the texts alone, and sorts of their lines would spill.

Defined cases: a null text is empty; an empty text has no blocks and stays empty when merged; rows with the same doc_id and
the same text give their result once; rows with the same doc_id and different texts each give their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from evidence_engine.functions import text as tx
from evidence_engine.sources.scratch import parts_for

#: Bytes of input files for each partition of texts.
PART_BYTES = 1 << 20

# What ends a sentence, and lines that begin a paragraph of their own.
SENTENCE_END = "[。！？.!?:：；;]$"
LIST_OR_HEADING = r"^(#{1,6}\s|[-*+]\s|[0-9]+([.][0-9]+)*[.)、]?\s)"
CHAPTER = r"^(第\s*[0-9一二三四五六七八九十百]+\s*[章节篇部分]|[一二三四五六七八九十百]+[、.]|[(（][一二三四五六七八九十百]+[)）])"
TITLE = "^[A-Z一-鿿][^。！？.!?]*$"
TITLE_CHARS = 24
HEADING = r"^(#{1,6})\s+([^\n]+)$"
LEVELS = 6

_KEYS = ("doc_id", "text_hash")


def _frames() -> tuple[WindowSpec, WindowSpec, WindowSpec]:
    """A text's lines in order; those before a line; those up to and with it."""
    lines = Window.partitionBy(*_KEYS).orderBy("no")
    return lines, lines.rowsBetween(Window.unboundedPreceding, -1), lines.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def normalised(text: Column) -> Column:
    """Unix line ends, runs of blanks as one, stripped."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return tx.strip(F.regexp_replace(t, r"[\t ]+", " "))


def lines_of(docs: DataFrame, text_col: str) -> DataFrame:
    """doc_id, text_hash, no, line: the lines of each text, blanks at both ends gone."""
    texts = docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    once = texts.repartition(parts_for(docs, PART_BYTES), *_KEYS).groupBy(*_KEYS).agg(F.first("text").alias("text"))
    return once.select(*_KEYS, F.posexplode(F.split(normalised(F.col("text")), "\n")).alias("no", "line")).withColumn("line", tx.strip(F.col("line")))


def _joined(separator: str) -> Column:
    """A group's lines in order, without those that are null."""
    kept = F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("no", "line"))))
    return F.array_join(F.transform(kept, lambda x: x.line), separator)


def markdown_blocks(docs: DataFrame, content_col: str = "content") -> DataFrame:
    """doc_id, pos, type (heading, code, table or paragraph), text, section_path, level, lang of Markdown texts.

    A line is code if an odd number of fences stand before it. Islands are runs of lines of one kind; a heading and an
    opening fence begin one. A heading of level L cuts the section path to its first L - 1 parts and adds its own, so the
    depth after the i-th heading is the least of i and L_k + i - k over all headings k up to it, and a part of the path is
    the last heading of that depth. `lang` is that of a fence that is closed.
    """
    in_order, earlier, so_far = _frames()
    line = F.col("line")
    fence, head = line.startswith("```"), line.rlike(HEADING)
    rows = lines_of(docs, content_col).withColumn("fence", fence).withColumn("inside", F.count_if("fence").over(earlier) % 2 == 1)
    table = line.startswith("|") & line.endswith("|") & (F.length("line") >= 2)
    kind = F.when(F.col("inside") | F.col("fence"), "code").when(head, "heading").when(table, "table").when(line != "", "paragraph").otherwise("")
    rows = rows.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", HEADING, 1))).otherwise(0))
    starts = (F.col("fence") & ~F.col("inside")) | (F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.lag("kind").over(in_order))
    rows = rows.withColumn("starts", starts).withColumn("heads", F.count_if(F.col("level") > 0).over(so_far))
    least = F.min(F.when(F.col("level") > 0, F.col("level") - F.col("heads"))).over(so_far)
    rows = rows.withColumn("depth", (F.col("heads") + F.least(F.lit(0), least)).cast("int")).withColumn("island", F.count_if("starts").over(so_far))
    title = tx.strip(F.regexp_extract("line", HEADING, 2))
    parts = [F.last(F.when((F.col("level") > 0) & (F.col("depth") == p), title), ignorenulls=True).over(so_far) for p in range(1, LEVELS + 1)]
    path = F.array_join(F.slice(F.array(*parts), F.lit(1), F.col("depth")), " / ")
    lang = F.when(F.col("fence") & ~F.col("inside"), F.regexp_extract("line", r"^```\s*([A-Za-z0-9_+.-]*)", 1))
    text = F.when(F.col("level") > 0, title).when(~F.col("fence"), line)
    rows = rows.select(*_KEYS, "no", "island", "kind", "level", "fence", path.alias("section_path"), lang.alias("lang"), text.alias("line"))
    blocks = rows.where("kind <> ''").groupBy(*_KEYS, "island").agg(
        F.first("kind").alias("type"), tx.strip(_joined("\n")).alias("text"), F.first("section_path").alias("section_path"), F.max("level").alias("level"),
        F.when(F.count_if("fence") == 2, F.max("lang")).otherwise("").alias("lang"),
    )
    pos = (F.row_number().over(Window.partitionBy(*_KEYS).orderBy("island")) - 1).alias("pos")
    return blocks.where("text <> ''").select("doc_id", pos, "type", "text", "section_path", "level", "lang")


def merged_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, text with broken lines joined by a blank; blank lines stay.

    A line begins a paragraph whatever stands before: after a blank line or the end of a sentence, as an item, heading or
    table row, or after a table row. What else begins one depends on where the current paragraph began. A short title
    as its first line ends it there; if it began with a bar, it ends with the line that closes the bar; any other
    first line takes in all up to the next line that begins one whatever stands before. So a line begins a paragraph unless
    such a first line, or an open bar, lies between it and the last of those. A line of a bar alone opens none.
    """
    in_order, earlier, so_far = _frames()
    line, before = F.col("line"), F.lag("line").over(in_order)
    row = lambda x: (F.length(x) >= 2) & x.startswith("|") & x.endswith("|")
    blank = line == ""
    sure = before.isNull() | blank | (before == "") | before.rlike(SENTENCE_END) | line.rlike(LIST_OR_HEADING) | line.rlike(CHAPTER) | row(line) | row(before)
    opens = line.startswith("|") & (F.length("line") >= 2) & ~line.endswith("|")
    title = (F.length("line") < TITLE_CHARS) & line.rlike(TITLE)
    rows = lines_of(docs, text_col).withColumn("sure", sure).withColumn("opens", opens).withColumn("closes", line.endswith("|")).withColumn("title", title | blank)
    place = lambda c, frame: F.coalesce(F.max(F.when(F.col(c), F.col("no"))).over(frame), F.lit(-1))
    rows = rows.withColumn("since", place("sure", so_far)).withColumn("opened", place("opens", earlier)).withColumn("closed", place("closes", earlier))
    rows = rows.withColumn("within", ~F.col("sure") & (F.col("opened") >= F.col("since")) & (F.col("opened") > F.col("closed")))
    rows = rows.withColumn("takes", ~F.col("within") & ~F.col("opens") & ~F.col("title"))
    begins = F.col("sure") | (~F.col("within") & (place("takes", earlier) < F.col("since")))
    rows = rows.select(*_KEYS, "no", F.concat(F.when(begins, "\n").otherwise(" "), line).alias("line"))
    return rows.groupBy(*_KEYS).agg(tx.strip(_joined("")).alias("text")).select("doc_id", "text")
