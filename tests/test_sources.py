"""File readers and the services over them."""

import io
import zipfile

from evidence_engine.plans import api
from evidence_engine.plans.documents import PAPERS
from evidence_engine.sources import files


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = office({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
XLSX = office({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Results" sheetId="1"/></sheets></workbook>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Model</t></si><si><t>Score</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="inlineStr"><is><t>A</t></is></c><c><v>3.5</v></c></row><row><c/></row></sheetData></worksheet>',
})


def test_files(spark, tmp_path):
    for name, data in {"a.docx": DOCX, "b.xlsx": XLSX, "c.csv": b"x,y\n1,2\n", "d.html": b"<h1>T</h1><p>p</p>", "e.md": "﻿# 标题".encode(), "f.txt": "中文".encode("gb18030"), "g": b"# like markdown", "h.docx": b"broken", "i.pdf": b"%PDF-1.4 text", "j.txt": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: (r.type, r.content) for r in files.read_files(spark, f"file://{tmp_path}").collect()}
    assert got["a.docx"] == ("docx", "## Top\n\nOne two\n\n| a | b |\n| --- | --- |")
    assert got["b.xlsx"] == ("xlsx", "## Results\n\n| Model | Score |\n| --- | --- |\n| A | 3.5 |")
    assert got["c.csv"] == ("csv", "| x | y |\n| --- | --- |\n| 1 | 2 |") and got["d.html"][1] == "# T\np\n"
    assert got["e.md"] == ("md", "# 标题") and got["f.txt"] == ("txt", "中文") and got["g"][0] == "md"
    assert got["h.docx"] == ("docx", "broken") and got["i.pdf"][0] == "pdf" and "j.txt" not in got  # Spark lists no empty files


def test_arxiv_and_content_lists(spark):
    pages = spark.createDataFrame([("https://arxiv.org/abs/2101.00001v2", '<meta name="citation_title" content="A title"><meta name="citation_author" content="X, Y"><meta name="citation_author" content="Z">'), ("https://else.org", "")], "url string, html string")
    assert [tuple(r) for r in files.arxiv_pages(pages).collect()] == [("2101.00001v2", "A title", "X, Y; Z", "")]
    rows = spark.createDataFrame([(1, [("text", "Head", 2, None, None), ("text", "body", 0, None, None), ("table", None, 0, "| a |", None), ("equation", None, 0, None, "x^2"), ("image", None, 0, None, None)])], "doc_id long, items array<struct<type:string,text:string,text_level:int,table_body:string,latex:string>>")
    assert files.content_list(rows).first().content == "## Head\n\nbody\n\n| a |\n\n$$x^2$$"


def test_ingest_twice_gives_the_same_graph(spark):
    docs = spark.createDataFrame(PAPERS, "doc_id long, title string, content string")
    corpus = api.ingest(docs)
    nodes, edges = corpus.nodes.collect(), corpus.edges.collect()
    assert {"paper", "section", "chunk", "method", "dataset", "metric", "table", "code", "reference"} <= {n.type for n in nodes}
    assert {"PAPER_HAS_SECTION", "CHILD_SECTION", "PARENT_SECTION", "SECTION_HAS_CHUNK", "NEXT_CHUNK", "PREV_CHUNK", "PAPER_HAS_METHOD", "METHOD_EVALUATED_ON_DATASET", "METHOD_REPORTED_METRIC", "SECTION_HAS_TABLE", "SECTION_HAS_CODE"} <= {e.relation for e in edges}
    assert len({n.node_id for n in nodes}) == len(nodes) and {e.source for e in edges} | {e.target for e in edges} <= {n.node_id for n in nodes}
    again = api.ingest(docs.unionByName(docs.limit(0)))
    assert {n.node_id for n in again.nodes.collect()} == {n.node_id for n in nodes}


def test_answer(spark):
    docs = spark.createDataFrame(PAPERS, "doc_id long, title string, content string")
    corpus = api.ingest(docs)
    asked = spark.createDataFrame([(1, "Sparse Window Net blocks"), (2, "zzz")], "query_id long, text string")
    found, grade, verified = api.answer(asked, corpus.chunks)
    assert found.where("query_id = 1 and rank = 1").first().content.startswith("Method: Sparse Window Net")
    assert {r.query_id: r.action for r in grade.collect()}[2] == "adjust_strategy"
    assert verified.where("query_id = 1").first().supported
    left = api.delete_documents(corpus, docs.where("doc_id = 1").select("doc_id"))
    assert left.chunks.where("doc_id = 1").count() == 0 and api.document_graph(corpus, 1)[0].count() > 5
