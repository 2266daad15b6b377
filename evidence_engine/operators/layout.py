"""Text of pages: headings told from body text, running heads dropped."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions import text as tx

# Numbering of headings, words that are headings by themselves.
NUMBERED = "^(第[ ]*[0-9一二三四五六七八九十百]+[ ]*[章节篇部分]|[一二三四五六七八九十百]+[、.]|[(（][一二三四五六七八九十百]+[)）]|[0-9]+([.][0-9]+){0,3}[.)、]?)[ ]*"
HEADS = "(?i)^(abstract|introduction|related work|background|preliminaries|materials and methods|methodology|methods?|experiments?|evaluation|results|discussion|conclusions?|references|bibliography)( |$)|^(摘要|引言|绪论|研究背景|研究意义|相关工作|文献综述|研究现状|方法|模型|算法|系统设计|实验|结果|结论|总结|参考文献|致谢)"
NOT_HEADS = "^%PDF|^[0-9]+ [0-9]+ obj|[=+{}\\\\•]|(?i)^page [0-9]+|(?i)(^|[^a-z])(issn|doi)([^a-z]|$)|[0-9]{4}[ ]*年[ ]*[0-9]+[ ]*月|(?i)^(figure|fig[.]|table|图|表)[ ]*[0-9]+"
SKIPPED = "^[-—· ]*[0-9]+[-—· ]*$|(?i)^page [0-9]+|(?i)(^|[^a-z])(issn|doi)([^a-z]|$)|10[.][0-9]{4,9}[ ]*/|[<>≤≥]|[0-9]+[ ]*%"


def is_heading(line: Column) -> Column:
    """Whether a line reads as a heading: numbered, a known word, or upper case of some words."""
    title = F.regexp_replace(line, NUMBERED, "")
    numbered = line.rlike(NUMBERED) & (F.length(title) >= 2) & (F.length(title) <= 60) & ~title.rlike("[=+∑≤≥]|[，,）。)]$")
    upper = (F.upper(line) == line) & (F.lower(line) != line) & (F.length(line) >= 4) & (F.length(line) <= 70) & F.contains(line, F.lit(" "))
    return (line != "") & (F.length(line) <= 90) & ~line.rlike(NOT_HEADS) & (numbered | line.rlike(HEADS) | upper)


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, pos, text, section: paragraphs between blank lines, each under the last heading before it."""
    parts = F.filter(F.transform(F.split(F.regexp_replace("text", r"\r\n?", "\n"), r"\n[ \t]*\n"), tx.strip), lambda p: p != "")
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "text"))
    head = F.when(~F.contains("text", F.lit("\n")) & is_heading(F.col("text")), F.col("text"))
    section = F.last("head", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("head", head).withColumn("section", F.coalesce(section, F.lit(""))).where("head is null").select("doc_id", "pos", "text", "section")


def _without_echoes(rows: pd.DataFrame) -> pd.DataFrame:
    """A document's lines in order, a heading that is among the last six headings dropped."""
    seen: list[str] = []
    keep = []
    for r in rows.sort_values("line").itertuples():
        key = re.sub(r"[^a-z0-9一-鿿]+", "", r.text.lower()) if r.heading else ""
        keep.append(not (key and key in seen[-6:]))
        if key and keep[-1]:
            seen.append(key)
    return rows.sort_values("line")[keep]


def layout_lines(lines: DataFrame) -> DataFrame:
    """doc_id, line, text, heading of lines(doc_id, page, line, text, size, bold, centered): noise and running heads gone,
    headings by their wording and by size, weight or place against the document's median size."""
    key = F.regexp_replace(F.regexp_replace(F.lower("text"), "[0-9]+", "#"), "[^a-z#一-鿿]+", "")
    keyed = lines.withColumn("key", F.when(F.length(key) >= 4, key))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    on = keyed.where("key is not null").groupBy("doc_id", "key").agg(F.countDistinct("page").alias("on"))
    rows = keyed.join(on, ["doc_id", "key"], "left").join(pages, "doc_id")
    again = (F.col("pages") >= 3) & F.coalesce(F.col("on") >= F.greatest(F.lit(3), F.floor(F.col("pages") * 35 / 100)), F.lit(False))
    rows = rows.withColumn("repeated", again)
    body = rows.where("not repeated and size > 0").groupBy("doc_id").agg(F.median("size").alias("body"))
    text = tx.strip(F.col("text"))
    large = (F.col("size") >= F.col("body") + 0.8) & (F.col("bold") | F.col("centered")) & (F.length(text) <= 60)
    looks = is_heading(text) & (text.rlike(NUMBERED) & (F.length(text) <= 50) | large | (F.col("bold") & (F.length(text) <= 45)) | (F.col("centered") & (F.length(text) <= 32)))
    kept = rows.join(body, "doc_id", "left").where((text != "") & ~F.col("repeated") & ~text.rlike(SKIPPED))
    marked = kept.select("doc_id", "line", text.alias("text"), F.coalesce(looks & ~text.rlike("[，。；：,;:]"), F.lit(False)).alias("heading"))
    return marked.groupBy("doc_id").applyInPandas(_without_echoes, "doc_id long, line long, text string, heading boolean")


def chunk_header() -> Column:
    """A chunk row's (paper_title, authors, year, section_path, chunk_type, method_name, dataset, metric, text) as
    self-describing text with header lines."""
    line = lambda label, c: F.concat(F.lit(f"【{label}】"), F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    kind = F.col("chunk_type")
    base = [line("论文", "paper_title"), line("章节", "section_path"), line("类型", "chunk_type")]
    long = [line("论文", "paper_title"), line("作者", "authors"), line("年份", "year"), line("章节", "section_path"), line("类型", "chunk_type")]
    made = lambda parts, label: F.concat_ws("\n", *parts, F.lit(f"【{label}】"), "text")
    return (
        F.when(kind == "table", made(base, "内容")).when(kind == "code", made(base, "代码")).when(kind == "equation", made(base, "公式"))
        .when(kind == "experiment", made([*base, line("数据集", "dataset"), line("指标", "metric")], "内容")).when(kind == "method", made([*long, line("方法", "method_name")], "正文")).otherwise(made(long, "正文"))
    )

