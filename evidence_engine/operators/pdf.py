"""Text of PDF files: tables of contents, headings set apart, and how good a parse is.

Lines come as lines(doc_id, line, text), parses as typed blocks and chunks; everything is Columns and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions import text as tx
from evidence_engine.operators.layout import is_heading
from evidence_engine.operators.parsing import heading_key, heading_similarity, section_type

# Marks of a table of contents, its leaders, front matter, and numbering.
TOC_MARK = "(?i)^(目[ ]*录|contents)$"
TOC_LEADER = "[·.。．…]{4,}[ ]*[0-9]+[ ]*$"
TOC_TAIL = "[·.。．… ]{2,}[0-9]+[ ]*$|[ ]+[0-9]+[ ]*$"
FRONT = "(?i)^(摘[ ]*要|abstract|插图索引|表格索引|附录|致谢)$"
CHAPTER, NUMBER = "^第[ ]*[0-9一二三四五六七八九十百]+[ ]*[章节篇部分]", "^[0-9]+([.][0-9]+)*"
NUMBERED_HEADING = "^(第[ ]*[0-9一二三四五六七八九十百]+[ ]*[章节篇部分]|[一二三四五六七八九十百]+[、.]|[(][一二三四五六七八九十百]+[)]|[0-9]+([.][0-9]+){0,3}[.)、]?)[ ]*"
TOC_LINES, TOCS_MOST, SAME = 180, 2, 820_000
#: The sections of a paper in their order, and the kinds of chunks that speak for a parse.
SECTIONS = ("abstract", "introduction", "related_work", "method", "experiment", "conclusion", "reference")
GOOD_CHUNKS = ("abstract", "related_work", "method", "experiment", "conclusion", "reference")
#: Headings that are page furniture, addresses, figures or list items.
NOISE = (
    "(?i)(^|[^a-z])(issn|cn[ ]*[0-9]|doi)([^a-z]|$)", "[0-9]{4}[ ]*年[ ]*[0-9]+[ ]*月|第[ ]*[0-9]+[ ]*[卷期]|总第[ ]*[0-9]+[ ]*期", "^[0-9]+([.][0-9]+)?[ ]*万", "^[0-9]{4} +", "^[0-9]+([.][ ]*[0-9]+)+[ ]*文献",
    "(^|[^0-9A-Za-z])10[.][0-9]{4,9}[ ]*/", "^[0-9]+[*＊]?[ ]*[，,]", "[<>≤≥]|[0-9]+[ ]*%", "^[（(][0-9]+[）)]", "(大学|学院|研究院|自治区|省|市|区|县|镇).{0,60}[0-9]{6}", "^[0-9]+ +[A-Za-z][A-Za-z ]+$", "^[-—· ]*[0-9]+[-—· ]*$",
    "^[%％，。,.)）]", "^[0-9]{1,3}[］\\]][.][ ]*(https?[:：]//|www[.]|[A-Za-z]+[.])", "^[0-9]+([.][ ]*[0-9]+)?[ ]*[，,、%％]", "^[0-9]+[ ]*本[、，,]",
)
NOISE_WORDS = ("model", "models", "模型", "method", "methods", "results", "experiments", "evaluation")
CAPITALS, LIST_ITEM = "^[A-Z][A-Z0-9. ]{2,}$", "^([（(]?[0-9]+[）)]|[0-9]+[.])[ ]*"


def numbered_heading(line: Column) -> Column:
    """Whether a line reads as a numbered heading: a number, then a title of 2 to 40 Chinese characters or up to 12 words."""
    text = F.regexp_replace(F.regexp_replace(tx.strip(line), "（", "("), "）", ")")
    title = F.regexp_replace(text, NUMBERED_HEADING, "")
    words = F.size(tx.all_of(title, "[A-Za-z][A-Za-zÀ-ɏ-]*"))
    bad = title.rlike("[=+∑σ−∞≤≥]|(?i)(^|[^a-z])(otherwise|if|where)([^a-z]|$)") | title.rlike("^[ ]*[%％，,。.)）]|[，,）。)][ ]*$")
    chinese = title.rlike("[一-鿿]")
    fits = F.when(chinese, (F.length(title) >= 2) & (F.length(title) <= 40)).otherwise((words >= 1) & (words <= 12) & ((words > 1) | (section_type(title, F.lit("")) != "paragraph")))
    number = F.regexp_extract(text, "^([0-9]+)([.][0-9]+)*", 1)
    huge = ~F.contains(F.regexp_extract(text, NUMBER, 0), F.lit(".")) & (F.length(number) > 2)
    return text.rlike(NUMBERED_HEADING) & (F.length(title) >= 2) & ~bad & fits & ~huge


def is_toc_line(line: Column) -> Column:
    return tx.strip(line).rlike(TOC_MARK) | line.rlike(TOC_LEADER)


def toc_entry(line: Column) -> tuple[Column, Column]:
    """(heading, level) of a line of a table of contents; null if it is none."""
    text = tx.strip(line)
    title = tx.strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, TOC_TAIL, ""), "（", "("), "）", ")"))
    number = F.regexp_extract(title, NUMBER, 0)
    level = F.when(title.rlike(CHAPTER) | (number == ""), 1).otherwise(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)
    ok = (text != "") & (F.length(text) <= 180) & numbered_heading(title)
    return F.when(ok, title), F.when(ok, level)


def toc_headings(lines: DataFrame) -> DataFrame:
    """doc_id, place, heading, level: the entries below a document's first two marks of a table of contents, each once."""
    text = tx.strip(F.col("text"))
    rows = lines.select("doc_id", "line", text.alias("text"))
    marks = rows.where(F.col("text").rlike(TOC_MARK)).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))).where(F.col("n") <= TOCS_MOST).select("doc_id", F.col("line").alias("from"), "n")
    heading, level = toc_entry(F.col("text"))
    front = F.when(F.col("text").rlike("[一-鿿]"), F.regexp_replace("text", " ", "")).otherwise(F.col("text"))
    met = rows.join(marks, "doc_id").where((F.col("line") > F.col("from")) & (F.col("line") < F.col("from") + TOC_LINES))
    found = met.select("doc_id", "n", "line", F.when(F.col("text").rlike(FRONT), front).otherwise(heading).alias("heading"), F.when(F.col("text").rlike(FRONT), 0).otherwise(level).alias("level"))
    found = found.where((F.length("heading") <= 90) & (heading_key(F.col("heading")) != "")).withColumn("key", heading_key(F.col("heading")))
    first = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("n", "line"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "line"))
    return found.withColumn("f", first).where("f = 1").withColumn("place", place).select("doc_id", "place", "heading", "level")


def match_toc(lines: DataFrame, toc: DataFrame) -> DataFrame:
    """doc_id, line, heading, similarity (millionths): for each line the entry that it is most like, if that is 0.82 or more;
    lines of the table itself and long ones match none."""
    rows = lines.where((F.length("text") <= 120) & (tx.strip(F.col("text")) != "") & ~is_toc_line(F.col("text")))
    met = rows.join(toc.select("doc_id", "place", "heading"), "doc_id").withColumn("similarity", tx.scaled(heading_similarity(F.col("text"), F.col("heading"))))
    best = met.groupBy("doc_id", "line").agg(F.max_by(F.struct("heading", "similarity"), F.struct("similarity", -F.col("place"))).alias("b"))
    return best.select("doc_id", "line", "b.*").where(F.col("similarity") >= SAME)


def keep_heading(heading: Column, matched: Column) -> Column:
    """Whether a heading stays one: the table of contents has it, or it names a known section."""
    return matched.isNotNull() | (section_type(heading, F.lit("")) != "paragraph") | tx.strip(heading).rlike("(?i)^(摘[ ]*要|abstract|参考文献|references|bibliography)$")


def normalise_lines(lines: DataFrame, toc: DataFrame) -> DataFrame:
    """doc_id, line, text, heading: lines without those of the table of contents; a heading is one that the table has, then
    in the table's words, or a line that reads as one and stands alone (two blank lines before or behind), is numbered or
    names a section. In a document with a table, a numbered line that it lacks is text."""
    text = tx.strip(F.col("text"))
    near = Window.partitionBy("doc_id").orderBy("line")
    blank = lambda a, b: F.coalesce(F.max((text != "").cast("int")).over(near.rowsBetween(a, b)), F.lit(0)) == 0
    rows = lines.withColumns({"alone": blank(-2, -1) | blank(1, 2), "text": text})
    rows = rows.join(match_toc(lines, toc).select("doc_id", "line", F.col("heading").alias("entry")), ["doc_id", "line"], "left")
    rows = rows.join(toc.select("doc_id").distinct().withColumn("has_toc", F.lit(True)), "doc_id", "left").where(~is_toc_line(F.col("text")))
    known = section_type(F.col("text"), F.lit("")) != "paragraph"
    numbered = numbered_heading(F.col("text"))
    foreign = F.coalesce("has_toc", F.lit(False)) & F.col("entry").isNull() & numbered & ~known
    number = F.col("text").rlike("(?i)(^|[^a-z])cn([^a-z]|$)")
    reads = ((is_heading(F.col("text")) & ~number) | numbered) & (F.col("alone") | numbered | known)
    heading = (F.col("text") != "") & (F.col("entry").isNotNull() | (reads & ~foreign))
    return rows.select("doc_id", "line", F.coalesce("entry", "text").alias("text"), heading.alias("heading"))


def list_item(heading: Column) -> Column:
    text = tx.strip(heading)
    return text.rlike(LIST_ITEM) & (text.rlike("[，。：；,;:]") | (text.rlike("^[0-9]+[.]") & (F.length(text) > 35) & (section_type(text, F.lit("")) == "paragraph")))


def noise_heading(heading: Column) -> Column:
    """Whether what was taken for a heading is page furniture, an address, a figure or an item of a list."""
    text = tx.strip(F.coalesce(heading, F.lit("")))
    out = list_item(text) | F.lower(text).isin(*NOISE_WORDS) | (text.rlike(CAPITALS) & ~F.lower(text).isin("abstract", "references"))
    out = out | (text.rlike("[。.]$") & ~text.rlike("^([0-9]+([.][0-9]+){0,3}|[一二三四五六七八九十]+[、.])"))
    for pattern in NOISE:
        out = out | text.rlike(pattern)
    return out


def section_order_score(types: Column) -> Column:
    """0.6 for each of a paper's sections among the types, 4 at most; nothing for one alone."""
    n = F.size(F.array_intersect(types, F.array(*(F.lit(s) for s in SECTIONS))))
    return F.when(n < 2, 0.0).otherwise(F.least(F.lit(4.0), n * 0.6))


def hierarchy_score(headings: Column) -> Column:
    """For numbered headings 0.12 each, for nested numbers 0.22 more and for plain ones 0.08; 5 at most."""
    text = F.transform(headings, lambda h: F.regexp_replace(F.regexp_replace(tx.strip(h), "（", "("), "）", ")"))
    number = F.transform(text, lambda h: F.when(h.rlike(CHAPTER), "chapter").otherwise(F.replace(F.regexp_extract(h, "^[0-9]+([.][ ]*[0-9]+){0,3}", 0), F.lit(" "), F.lit(""))))
    n = F.size(F.filter(number, lambda x: x != ""))
    nested = F.size(F.filter(number, lambda x: F.contains(x, F.lit("."))))
    plain = F.size(F.filter(number, lambda x: (x != "") & (x != "chapter") & ~F.contains(x, F.lit("."))))
    return F.least(F.lit(5.0), n * 0.12 + nested * 0.22 + plain * 0.08)


def parse_scores(blocks: DataFrame, chunks: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """The quality of each document's parse into blocks(doc_id, type, text, section_type) and chunks(doc_id, chunk_type,
    content): the measures, the score (millionths) and why it would be rejected; baseline(doc_id, baseline_len) is the
    length of the text that another parser found."""
    head = F.col("type") == "heading"
    body = F.when(~head & (tx.strip(F.col("text")) != ""), F.length(tx.strip(F.col("text"))))
    by_block = blocks.groupBy("doc_id").agg(
        F.count_if(head).alias("headings"), F.collect_list(F.when(head, F.col("text"))).alias("heads"), F.collect_set(F.coalesce("section_type", "type")).alias("types"), F.count_if(head & noise_heading(F.col("text"))).alias("noise"),
        F.count_if(head & (F.length("text") > 70) & (section_type(F.col("text"), F.lit("")) == "paragraph")).alias("long_heads"), F.count_if(head & list_item(F.col("text"))).alias("list_heads"),
        F.coalesce(F.sum(body), F.lit(0)).alias("content_len"), F.coalesce(F.max(body), F.lit(0)).alias("max_block"), F.coalesce(F.avg(body), F.lit(0.0)).alias("avg_block"), F.coalesce(F.count_if(body < 40) / F.nullif(F.count(body), F.lit(0)), F.lit(1.0)).alias("short_share"),
    )
    by_chunk = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("content")).alias("max_chunk"), F.collect_set("chunk_type").alias("chunk_types"))
    rows = by_block.join(by_chunk, "doc_id", "left").withColumns({"n_chunks": F.coalesce("n_chunks", F.lit(0)), "max_chunk": F.coalesce("max_chunk", F.lit(0)), "chunk_types": F.coalesce("chunk_types", F.array().cast("array<string>"))})
    rows = rows.join(baseline, "doc_id", "left") if baseline is not None else rows.withColumn("baseline_len", F.lit(None).cast("long"))
    base = F.nullif(F.col("baseline_len"), F.lit(0))
    ratio = F.coalesce(F.col("content_len") / base, F.lit(1.0))
    density = F.coalesce(F.col("noise") / F.nullif(F.col("headings"), F.lit(0)), F.lit(0.0))
    n_sections = F.size(F.array_intersect("types", F.array(*(F.lit(s) for s in SECTIONS))))
    n_good = F.size(F.array_intersect("chunk_types", F.array(*(F.lit(s) for s in GOOD_CHUNKS))))
    c, one = F.col, lambda cond, x: F.when(cond, x).otherwise(0.0)
    score = F.least(c("headings"), F.lit(80)) * 0.22 + n_sections * 2.2 + n_good * 1.2 + section_order_score(c("types")) + hierarchy_score(c("heads")) + F.least(c("n_chunks"), F.lit(40)) * 0.08
    score = score + one(c("avg_block") >= 80, 1.0) + one((c("short_share") >= 0.04) & (c("short_share") <= 0.45), 1.0)
    score = score - c("noise") * 6.0 - c("long_heads") * 2.0 - c("list_heads") * 4.0 - F.greatest(F.lit(0), c("headings") - 120) * 0.2
    score = score - one(c("max_block") > 6000, (c("max_block") - 6000) / 500) - one(c("max_chunk") > 1800, F.least(F.lit(8.0), (c("max_chunk") - 1800) / 500))
    score = score - one(c("short_share") > 0.55, (c("short_share") - 0.55) * 8.0) - one(base.isNotNull() & (ratio < 0.65), (0.65 - ratio) * 12.0)
    reasons = F.array_compact(F.array(F.when(base.isNotNull() & (ratio < 0.45), "short"), F.when(density > 0.15, "noise"), F.when(c("n_chunks") == 0, "no_chunks"), F.when(c("max_chunk") > 6000, "long_chunk")))
    return rows.select("doc_id", "headings", "noise", n_sections.alias("sections"), "content_len", "max_block", tx.scaled(c("short_share")).alias("short_share"), "n_chunks", "max_chunk", F.size("chunk_types").alias("chunk_kinds"), tx.scaled(score).alias("score"), F.array_join(reasons, ",").alias("reasons"))


def good_enough(q: DataFrame) -> DataFrame:
    """doc_id, good: whether a text parse needs no look at the page layout."""
    c = F.col
    ok = (c("score") >= 35_000_000) & (c("noise") == 0) & (c("sections") >= 4) & (c("headings") >= 8) & (c("n_chunks") >= 8) & (c("max_chunk") <= 1700) & (c("short_share") <= 500_000) & (c("content_len") >= 3000)
    return q.select("doc_id", ok.alias("good"))


def layout_decision(text: DataFrame, layout: DataFrame) -> DataFrame:
    """doc_id, threshold, use_layout, decision from the scores of both parses of a document: the layout's must be better by a
    threshold that follows the text's faults, or be clean where the text is noisy."""
    cols = ("score", "noise", "sections", "headings", "short_share", "n_chunks", "max_chunk", "reasons")
    name = lambda df, p: df.select("doc_id", *(F.col(x).alias(f"{p}_{x}") for x in cols))
    rows = name(text, "t").join(name(layout, "l"), "doc_id")
    c = F.col
    threshold = F.when((c("t_noise") == 0) & (c("t_sections") >= 4) & (c("t_headings") >= 20), 8.0).when((c("t_noise") >= 3) | (c("t_short_share") > 550_000), 2.5).otherwise(5.0)
    better = c("l_score") >= c("t_score") + threshold * 1_000_000
    fewer = (c("l_n_chunks") <= F.greatest(F.lit(45), F.floor(c("t_n_chunks") * 0.65))) & (c("l_max_chunk") <= F.greatest(F.lit(1800.0), c("t_max_chunk") * 1.15))
    rescue = (c("t_noise") >= 3) & (c("l_noise") == 0) & fewer & (c("l_score") >= c("t_score") + 2_000_000)
    use = (c("l_reasons") == "") & (better | rescue)
    decision = F.when(use, "layout better").when(c("l_reasons") != "", "layout rejected").otherwise("text fallback")
    return rows.select("doc_id", tx.scaled(threshold).alias("threshold"), use.alias("use_layout"), decision.alias("decision"))
