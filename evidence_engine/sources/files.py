"""Files as documents: text, Markdown, HTML, CSV, DOCX and XLSX bytes into Markdown, one row a file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.operators.parsing import csv_to_markdown, html_to_markdown, rows_to_markdown

# Types by extension, the XML names of office files.
TYPES = {"md": "md", "markdown": "md", "html": "html", "htm": "html", "csv": "csv", "docx": "docx", "xlsx": "xlsx", "pdf": "pdf", "txt": "txt"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def decode(data: bytes) -> str:
    """UTF-8 with or without a mark, else GB18030, else UTF-8 with replacements."""
    for name in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def guess_type(name: str, head: str = "") -> str:
    """By extension; a file of another one by what it looks like."""
    kind = TYPES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None
    if kind:
        return kind
    if re.search(r"(?i)<(html|body|p|div|h[1-6])\b", head):
        return "html"
    return "md" if re.search(r"(?m)^(#{1,6} |```|\|.+\|$)", head) else "txt"


def docx_to_markdown(data: bytes) -> str:
    """Paragraphs and tables of a document's body; the styles Heading1 to Heading6 become headings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}tbl":
            out.append(rows_to_markdown([[text(c) for c in row.iter(f"{_W}tc")] for row in node.iter(f"{_W}tr")]))
        elif node.tag == f"{_W}p" and (line := text(node)):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"[Hh]eading ?([1-6])", style.get(f"{_W}val", "")) if style is not None else None
            out.append(f"{'#' * int(level.group(1))} {line}" if level else line)
    return "\n\n".join(out)


def xlsx_to_markdown(data: bytes) -> str:
    """Each sheet as a heading and a table; shared and inline strings are resolved, empty rows go."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        rels = {}
        if "xl/_rels/workbook.xml.rels" in names:
            rels = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for k, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"), 1):
            target = rels.get(sheet.get(f"{_R}id"), f"worksheets/sheet{k}.xml")
            path = target if target.startswith("xl/") else f"xl/{target}"
            if path not in names:
                continue
            rows = []
            for row in ElementTree.fromstring(z.read(path)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    value, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
                    raw = "".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else (value.text or "") if value is not None else ""
                    cells.append(shared[int(raw)] if c.get("t") == "s" and raw.isdigit() and int(raw) < len(shared) else raw)
                if any(x.strip() for x in cells):
                    rows.append([x.strip() for x in cells])
            out.append(f"## {sheet.get('name')}\n\n{rows_to_markdown(rows)}")
    return "\n\n".join(out)


def to_markdown(name: str, data: bytes) -> tuple[str, str]:
    """(type, Markdown) of a file; a broken office file falls back to its bytes as text. A PDF is taken as text: there
    is no reader for its binary form here."""
    kind = guess_type(name, data[:2000].decode("utf-8", "ignore"))
    try:
        if kind == "docx":
            return kind, docx_to_markdown(data)
        if kind == "xlsx":
            return kind, xlsx_to_markdown(data)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return kind, decode(data)
    text = decode(data)
    if kind == "html":
        return kind, html_to_markdown(text)
    return kind, csv_to_markdown(text) if kind == "csv" else text


def csv_tables(rows: DataFrame) -> DataFrame:
    """rows(k, text) of CSV text as k, markdown, row_count (rows of data below the head) and sheet_count."""

    @F.pandas_udf("string")
    def table(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: csv_to_markdown(t or ""))

    lines = F.size(F.filter(F.split("markdown", "\n"), lambda x: x != ""))
    return rows.select("k", table("text").alias("markdown")).select("k", "markdown", F.greatest(lines - 2, F.lit(0)).alias("row_count"), F.lit(1).alias("sheet_count"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):  # a file may be large: one at a time
            path = batch.column(0)[k].as_py()
            kind, text = to_markdown(path.rsplit("/", 1)[-1], batch.column(1)[k].as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([kind]), pa.array([text])], names=["path", "type", "content"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, type, content (Markdown) of every file below a path; Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_read, "path string, type string, content string")


def arxiv_pages(pages: DataFrame) -> DataFrame:
    """arxiv_id, title, authors, abstract of abstract pages among pages(url, html), by their citation meta tags."""
    meta = lambda name: F.regexp_extract_all("html", F.lit(f'(?is)<meta[^>]*name="citation_{name}"[^>]*content="([^"]*)"'), F.lit(1))
    found = F.regexp_extract("url", "(?i)arxiv[.]org/(?:abs|html|pdf)/([0-9]{4}[.][0-9]{4,5}(?:v[0-9]+)?)", 1)
    out = pages.select(found.alias("arxiv_id"), F.element_at(F.concat(meta("title"), F.array(F.lit(""))), 1).alias("title"), F.array_join(meta("author"), "; ").alias("authors"), F.element_at(F.concat(meta("abstract"), F.array(F.lit(""))), 1).alias("abstract"))
    return out.where("arxiv_id <> ''")


def content_list(rows: DataFrame) -> DataFrame:
    """doc_id, content: Markdown of lists of items (type, text, text_level, table_body, latex), in their order."""
    item = lambda x: (
        F.when(x["type"] == "table", x["table_body"]).when(x["type"] == "equation", F.concat(F.lit("$$"), x["latex"], F.lit("$$")))
        .when(x["text_level"] > 0, F.concat(F.repeat(F.lit("#"), x["text_level"]), F.lit(" "), x["text"])).when(x["type"] == "text", x["text"])
    )
    return rows.select("doc_id", F.array_join(F.filter(F.transform("items", item), lambda t: t.isNotNull() & (t != "")), "\n\n").alias("content"))
