"""Queries of PDF text, references and academic results; literal inputs with answers worked out by hand or DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_engine.functions.text import scaled, strip
from evidence_engine.operators import academic, parsing, pdf
from evidence_engine.plans.documents import REFS
from evidence_engine.sources.literals import values_sql
from evidence_engine.sources.tables import read

# Headings with what they are: noise, and items of lists.
HEADINGS = [
    ("1 Introduction", True, False), ("2.1 Data and Models", False, False), ("ISSN 1000-1234", True, False), ("第3期 2020", True, False), ("2020 年 3 月", True, False), ("Related Work", False, False), ("RESULTS OF STUDY", True, False), ("ABSTRACT", False, False),
    ("models", True, False), ("增长 35%", True, False), ("(1) 第一步：准备", True, True), ("3. first, then second", True, True), ("- 12 -", True, False), ("结论。", True, False), ("三、方法。", False, False), ("10.1234 / x", True, False), ("第一章 绪论", False, False), ("", False, False), ("某大学某学院 100084", True, False),
]


def noise_headings(spark, sf):
    """Every line of the documents and the literal headings: how many of each kind, by length."""
    lines = read(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("heading")).unionByName(spark.createDataFrame([(h,) for h, _, _ in HEADINGS], "heading string"))
    return lines.groupBy(F.length(strip(F.col("heading"))).alias("length"), pdf.noise_heading(F.col("heading")).alias("noise"), pdf.list_item(F.col("heading")).alias("item")).agg(F.count("*").alias("n"))


def noise_labels(spark, sf):
    """The literal headings against their labels."""
    rows = spark.createDataFrame([(k, h) for k, (h, _, _) in enumerate(HEADINGS)], "k int, heading string")
    return rows.select("k", pdf.noise_heading(F.col("heading")).alias("noise"), pdf.list_item(F.col("heading")).alias("item"))


_STRIPPED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_ITEM = f"(regexp_matches(t, '{pdf.LIST_ITEM}') AND (regexp_matches(t, '[，。：；,;:]') OR regexp_matches(t, '^[0-9]+[.]') AND length(t) > 35))"
NOISE = f"""SELECT CAST(length(t) AS INTEGER) AS length, {_ITEM} OR lower(t) IN {pdf.NOISE_WORDS} OR regexp_matches(t, '{pdf.CAPITALS}') AND lower(t) NOT IN ('abstract', 'references')
  OR regexp_matches(t, '[。.]$') AND NOT regexp_matches(t, '^([0-9]+([.][0-9]+){{0,3}}|[一二三四五六七八九十]+[、.])') OR {" OR ".join(f"regexp_matches(t, '{x}')" for x in pdf.NOISE)} AS noise, {_ITEM} AS item, count(*) AS n
FROM (SELECT {_STRIPPED.format('h')} AS t FROM (SELECT unnest(string_split(text, chr(10))) AS h FROM documents UNION ALL SELECT h FROM {values_sql([(h,) for h, _, _ in HEADINGS], 'h')})) GROUP BY ALL"""
NOISE_LABELS = f"SELECT * FROM {values_sql([(k, n, i) for k, (_, n, i) in enumerate(HEADINGS)], 'k, noise, item')}"

#: A paper's text by lines, with a table of contents.
PAGE = [
    "Sparse Nets", "", "目 录", "摘 要 ........ 1", "第一章 绪论 ....... 2", "1.1 研究背景与意义 ...... 3", "2 Method of Windows ......... 5", "2.1 Window Blocks of Text 6", "1.1 研究背景与意义 ...... 3", "", "摘要", "本文研究稀疏网络。", "", "第一章 绪论", "1.1 研究背景与意义", "背景如下。", "3 Apples And Pears", "不在目录中。", "2 Method of Windows", "We cut the text into windows.", "", "", "CLOSING REMARKS HERE", "", "", "The end of it.",
]


def _page(spark):
    return spark.createDataFrame([(1, k, t) for k, t in enumerate(PAGE)] + [(2, k, t) for k, t in enumerate(["Intro text", "", "", "4 Results and Discussion", "It works.", "CN 11-1"])], "doc_id int, line int, text string")


def toc_headings(spark, sf):
    return pdf.toc_headings(_page(spark)).select("doc_id", "place", "heading", "level")


TOC = "SELECT * FROM (VALUES (1, 1, '第一章 绪论', 1), (1, 2, '1.1 研究背景与意义', 2), (1, 3, '2 Method of Windows', 1), (1, 4, '2.1 Window Blocks of Text', 2), (1, 5, '摘要', 0), (1, 6, '3 Apples And Pears', 1)) t(doc_id, place, heading, level)"


def toc_match(spark, sf):
    lines = _page(spark)
    return pdf.match_toc(lines, pdf.toc_headings(lines))


TOC_MATCH = "SELECT * FROM (VALUES (1, 10, '摘要', 1000000), (1, 13, '第一章 绪论', 1000000), (1, 14, '1.1 研究背景与意义', 1000000), (1, 18, '2 Method of Windows', 1000000), (1, 7, '2.1 Window Blocks of Text', 1000000), (1, 16, '3 Apples And Pears', 1000000)) t(doc_id, line, heading, similarity)"


def pdf_lines(spark, sf):
    lines = _page(spark)
    return pdf.normalise_lines(lines, pdf.toc_headings(lines)).where("heading").select("doc_id", "line", "text")


PDF_LINES = "SELECT * FROM (VALUES (1, 10, '摘要'), (1, 13, '第一章 绪论'), (1, 14, '1.1 研究背景与意义'), (1, 18, '2 Method of Windows'), (1, 22, 'CLOSING REMARKS HERE'), (1, 7, '2.1 Window Blocks of Text'), (1, 16, '3 Apples And Pears'), (2, 3, '4 Results and Discussion')) t(doc_id, line, text)"


def _parse(doc: int, heads: list[str], bodies: list[tuple[str, int]]) -> list[tuple]:
    """Blocks of a document: headings, and bodies of a type with a length."""
    return [(doc, "heading", h, "heading") for h in heads] + [(doc, t, "x" * n, t) for t, n in bodies]


_KINDS = ("abstract", "introduction", "related_work", "method", "experiment", "conclusion", "reference")
BLOCKS = (
    _parse(1, [f"{k}. Part-Number {c}" for k, c in enumerate("ABCDEFGHIJ", 1)] + ["2.1 Data and Models", "第一章 绪论"], [(t, 700) for t in _KINDS] + [("paragraph", 30), ("paragraph", 300)])
    + _parse(2, ["ISSN 1000-1234", "models", "(1) 第一步：准备", "1. Overview of Things"], [("paragraph", 20), ("paragraph", 7000), ("method", 10)]) + _parse(3, [], [("paragraph", 100)]) + _parse(4, ["Related Work"], [("related_work", 90), ("method", 50)])
)
CHUNKS = [(1, t, "x" * 700) for t in _KINDS] + [(1, "paragraph", "x" * 330), (1, "paragraph", "x" * 1500)] + [(2, "paragraph", "x" * 7020), (2, "method", "x" * 10)] + [(4, "related_work", "x" * 2800), (4, "method", "x" * 50)]
BASE = [(2, 9000), (4, 500), (1, 5000)]


def _scores(spark, based: bool):
    blocks = spark.createDataFrame(BLOCKS, "doc_id int, type string, text string, section_type string")
    chunks = spark.createDataFrame(CHUNKS, "doc_id int, chunk_type string, content string")
    return pdf.parse_scores(blocks, chunks, spark.createDataFrame(BASE, "doc_id int, baseline_len long") if based else None)


def pdf_parse_scores(spark, sf):
    return _scores(spark, True)


# Noise, list items and the headings' numbering are labelled by hand: document, headings, noise, items, numbered, nested, plain.
_HEADS = values_sql([(1, 12, 0, 0, 12, 1, 10), (2, 4, 3, 1, 1, 0, 1), (3, 0, 0, 0, 0, 0, 0), (4, 1, 0, 0, 0, 0, 0)], "doc_id, headings, noise, items, numbered, nested, plain")
_IN = ", ".join(f"'{k}'" for k in _KINDS)
PARSE_SCORES = f"""WITH b AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS content_len, max(n) AS max_block, avg(n) AS avg_block, count(*) FILTER (WHERE n < 40) / count(*) AS short_share, count(DISTINCT t) FILTER (WHERE t IN ({_IN})) AS sections
  FROM {values_sql([(d, s, len(t)) for d, k, t, s in BLOCKS if k != 'heading'], 'doc_id, t, n')} GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_chunks, max(n) AS max_chunk, count(DISTINCT t) AS chunk_kinds, count(DISTINCT t) FILTER (WHERE t IN ({_IN}) AND t <> 'introduction') AS good FROM {values_sql([(d, t, len(x)) for d, t, x in CHUNKS], 'doc_id, t, n')} GROUP BY doc_id),
r AS (SELECT doc_id, headings, noise, items, numbered, nested, plain, content_len, max_block, avg_block, short_share, sections, coalesce(n_chunks, 0) AS n_chunks, coalesce(max_chunk, 0) AS max_chunk, coalesce(chunk_kinds, 0) AS chunk_kinds, coalesce(good, 0) AS good, base, coalesce(content_len / base, 1) AS ratio
  FROM {_HEADS} h JOIN b USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN {values_sql(BASE, 'doc_id, base')} USING (doc_id))
SELECT doc_id, CAST(headings AS BIGINT) AS headings, CAST(noise AS BIGINT) AS noise, CAST(sections AS INTEGER) AS sections, content_len, CAST(max_block AS INTEGER) AS max_block, CAST(floor(short_share * 1e6 + 0.5) AS BIGINT) AS short_share, n_chunks, CAST(max_chunk AS INTEGER) AS max_chunk, CAST(chunk_kinds AS INTEGER) AS chunk_kinds,
  CAST(floor((least(headings, 80) * 0.22::DOUBLE + sections * 2.2::DOUBLE + good * 1.2::DOUBLE + CASE WHEN sections < 2 THEN 0 ELSE least(4.0::DOUBLE, sections * 0.6::DOUBLE) END + least(5.0::DOUBLE, numbered * 0.12::DOUBLE + nested * 0.22::DOUBLE + plain * 0.08::DOUBLE) + least(n_chunks, 40) * 0.08::DOUBLE
    + CASE WHEN avg_block >= 80 THEN 1 ELSE 0 END + CASE WHEN short_share BETWEEN 0.04 AND 0.45 THEN 1 ELSE 0 END - noise * 6.0::DOUBLE - items * 4.0::DOUBLE - CASE WHEN max_block > 6000 THEN (max_block - 6000) / 500 ELSE 0 END
    - CASE WHEN max_chunk > 1800 THEN least(8.0::DOUBLE, (max_chunk - 1800) / 500) ELSE 0 END - CASE WHEN short_share > 0.55 THEN (short_share - 0.55::DOUBLE) * 8 ELSE 0 END - CASE WHEN base IS NOT NULL AND ratio < 0.65 THEN (0.65::DOUBLE - ratio) * 12 ELSE 0 END) * 1e6 + 0.5) AS BIGINT) AS score,
  concat_ws(',', CASE WHEN base IS NOT NULL AND ratio < 0.45 THEN 'short' END, CASE WHEN headings > 0 AND noise / headings > 0.15 THEN 'noise' END, CASE WHEN n_chunks = 0 THEN 'no_chunks' END, CASE WHEN max_chunk > 6000 THEN 'long_chunk' END) AS reasons FROM r"""

_QUALITY = [
    (1, "t", 36_000_000, 0, 5, 20, 300_000, 30, 1500, "", 5000), (1, "l", 44_000_000, 0, 6, 25, 200_000, 28, 1500, "", 5100), (2, "t", 20_000_000, 4, 3, 10, 600_000, 90, 1900, "", 4000), (2, "l", 22_500_000, 0, 3, 10, 300_000, 40, 1700, "", 4000),
    (3, "t", 20_000_000, 1, 3, 10, 300_000, 90, 1900, "", 4000), (3, "l", 24_000_000, 0, 3, 10, 300_000, 40, 1700, "", 4000), (4, "t", 10_000_000, 0, 3, 10, 300_000, 10, 1000, "", 4000), (4, "l", 30_000_000, 0, 3, 10, 300_000, 40, 7000, "long_chunk", 4000),
    (5, "t", 40_000_000, 0, 4, 8, 500_000, 8, 1700, "", 3000), (5, "l", 41_000_000, 0, 4, 8, 500_000, 8, 1700, "", 3000), (6, "t", 20_000_000, 3, 3, 10, 300_000, 90, 1000, "", 4000), (6, "l", 22_300_000, 0, 3, 10, 300_000, 60, 1000, "", 4000),
]
_QCOLS = "doc_id int, which string, score long, noise int, sections int, headings int, short_share long, n_chunks int, max_chunk int, reasons string, content_len long"


def pdf_good_enough(spark, sf):
    return pdf.good_enough(spark.createDataFrame(_QUALITY, _QCOLS).where("which = 't'"))


GOOD = "SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false), (5, true), (6, false)) t(doc_id, good)"


def pdf_layout_decision(spark, sf):
    q = spark.createDataFrame(_QUALITY, _QCOLS)
    return pdf.layout_decision(q.where("which = 't'"), q.where("which = 'l'"))


# 1: eight points better than a good text; 2: the noisy text's lower threshold; 3: under five points; 4: rejected; 6: clean and two points better, but too many chunks.
DECISION = "SELECT * FROM (VALUES (1, 8000000, true, 'layout better'), (2, 2500000, true, 'layout better'), (3, 5000000, false, 'text fallback'), (4, 5000000, false, 'layout rejected'), (5, 5000000, false, 'text fallback'), (6, 2500000, false, 'text fallback')) t(doc_id, threshold, use_layout, decision)"


def section_scores(spark, sf):
    rows = spark.createDataFrame([(1, ["abstract", "method", "table"], ["1 A", "1.1 B", "第二章 C", "Intro"]), (2, ["abstract"], []), (3, list(_KINDS), [f"{k}.{k} X" for k in range(1, 30)])], "k int, types array<string>, heads array<string>")
    return rows.select("k", scaled(pdf.section_order_score(F.col("types"))).alias("order"), scaled(pdf.hierarchy_score(F.col("heads"))).alias("hierarchy"))


SECTION_SCORES = 'SELECT * FROM (VALUES (1, 1200000, 660000), (2, 0, 0), (3, 4000000, 5000000)) t(k, "order", hierarchy)'

# References

MORE_REFS = [*REFS, (5, "Vaswani A, Shazeer N. Attention is all you need. NeurIPS. 2017.\nDeep learning for text: a survey. Journal of Things 2020. doi:10.1000/abc.1.\nMary Shelley. On monsters. 2021.\narXiv:2005.11401")]


def reference_fields(spark, sf):
    refs = parsing.reference_fields(parsing.split_references(spark.createDataFrame(MORE_REFS, "ref_id long, text string")))
    return refs.select("ref_id", "pos", "authors", "title", "venue", "year", "doi", "arxiv_id", "citation_key")


REFERENCES = "SELECT CAST(ref_id AS BIGINT) AS ref_id, pos, authors, title, venue, year, doi, arxiv_id, citation_key FROM " + values_sql(
    [
        (1, 0, "Vaswani A., Shazeer N", "Attention is all you need", "NeurIPS 2017", "2017", "", "1706.03762", "ref-1"), (1, 1, "", "Lewis P", "et al. Retrieval-augmented generation. 2020. doi:", "2020", "10.1000/rag.7", "", "ref-2"), (1, 2, "", "Guu K", "REALM. 2020", "2020", "", "", "ref-3"),
        (2, 0, "", "Doe 2001", "A title", "2001", "", "", "doe2001"), (2, 1, "", "Roe 2002 2003", "Another title", "2003", "", "", "roe2003"), (3, 0, "", "Only one entry 1998, revised 2004", "", "2004", "", "", "ref-7"),
        (5, 0, "Vaswani A, Shazeer N", "Attention is all you need", "NeurIPS. 2017", "2017", "", "", "vaswani2017"), (5, 1, "", "Deep learning for text: a survey", "Journal of Things 2020. doi:", "2020", "10.1000/abc.1", "", "deep2020"), (5, 2, "Mary Shelley", "On monsters", "2021", "2021", "", "", "mary2021"), (5, 3, "", "", "", "2005", "", "2005.11401", "2005114012005"),
    ],
    "ref_id, pos, authors, title, venue, year, doi, arxiv_id, citation_key",
)

# Academic results: query_id, source, payload.
PAYLOADS = [
    (1, "semantic_scholar", '{"data": [{"paperId": "p1", "title": "Dense Retrieval", "abstract": "We retrieve.", "year": 2020, "authors": [{"name": "A"}, {"name": "B"}], "url": "https://x.org/1"}, {"paperId": "p2", "title": "Sparse"}]}'),
    (1, "arxiv", '[{"id": "2005.11401", "title": "RAG", "summary": "Generation with retrieval."}, {"title": "", "abstract": ""}, 5]'), (1, "semantic_match", '{"paperId": "p1", "title": "Dense Retrieval"}'),
    (1, "semantic_snippet", '{"results": [{"paper": {"title": "Dense Retrieval", "paperId": "p1"}, "snippet": "a long snippet of it"}]}'), (2, "semantic_author", '{"items": [{"authorId": "77", "name": "Ada Lovelace"}]}'),
    (3, "semantic_references", '{"papers": [{"title": "Ref one", "doi": "DOI:10.5/x", "contexts": ["c1", "c2", "c3", "c4"]}]}'), (3, "semantic_detail", '{"title": "The paper", "paperId": "q9", "openAccessPdf": {"url": "https://pdf.org/q9"}}'), (3, "semantic_match", '{"title": "The paper", "paperId": "q9"}'),
    (4, "semantic_scholar", '{"message": "nothing"}'), (5, "semantic_scholar", '{"content": [{"text": "{\\"results\\": [{\\"title\\": \\"Boxed\\", \\"id\\": \\"b1\\"}]}"}, {"text": "not json"}]}'), (5, "semantic_scholar", "broken {"),
]


def _rows(spark):
    return academic.normalise(academic.items_of(spark.createDataFrame(PAYLOADS, "query_id int, source string, payload string")))


def academic_normalise(spark, sf):
    return _rows(spark).select("query_id", "source", "rank", "title", "url", "snippet", "authors", "year", "paper_id")


NORMALISE = "SELECT * FROM " + values_sql(
    [
        (1, "semantic_scholar", 1, "Dense Retrieval", "https://x.org/1", "We retrieve.", "A, B", "2020", "p1"), (1, "semantic_scholar", 2, "Sparse", "https://www.semanticscholar.org/paper/p2", "", "", "", "p2"), (1, "arxiv", 1, "RAG", "https://arxiv.org/abs/2005.11401", "Generation with retrieval.", "", "", "2005.11401"),
        (1, "semantic_match", 1, "Dense Retrieval", "https://www.semanticscholar.org/paper/p1", "", "", "", "p1"), (1, "semantic_snippet", 1, "Dense Retrieval", "https://www.semanticscholar.org/paper/p1", "a long snippet of it", "", "", "p1"), (2, "semantic_author", 1, "Ada Lovelace", "https://www.semanticscholar.org/author/77", "", "", "", "77"),
        (3, "semantic_references", 1, "Ref one", "https://doi.org/10.5/x", "c1 c2 c3", "", "", "DOI:10.5/x"), (3, "semantic_detail", 1, "The paper", "https://pdf.org/q9", "", "", "", "q9"), (3, "semantic_match", 1, "The paper", "https://www.semanticscholar.org/paper/q9", "", "", "", "q9"), (5, "semantic_scholar", 1, "Boxed", "https://www.semanticscholar.org/paper/b1", "", "", "", "b1"),
    ],
    "query_id, source, rank, title, url, snippet, authors, year, paper_id",
)


def academic_union(spark, sf):
    return academic.union_searches(_rows(spark))


UNION = "SELECT * FROM " + values_sql([(1, 1, "2005.11401", "RAG", "arxiv"), (1, 2, "p1", "Dense Retrieval", "semantic_scholar"), (1, 3, "p2", "Sparse", "semantic_scholar"), (5, 1, "b1", "Boxed", "semantic_scholar")], "query_id, place, paper_id, title, source")


def academic_resolve(spark, sf):
    return academic.resolve_ids(_rows(spark))


RESOLVE = "SELECT * FROM (VALUES (1, 'p1'), (3, 'q9'), (5, 'b1')) t(query_id, paper_id)"


def academic_execute(spark, sf):
    plans = spark.createDataFrame([(1, "paper_search", ""), (2, "author_search", ""), (3, "paper_verify", ""), (4, "paper_citations", ""), (5, "paper_detail", "")], "query_id int, intent string, paper_id string")
    web = spark.createDataFrame([(q, r, f"web {q}.{r}") for q in range(1, 6) for r in (1, 2)], "query_id int, rank int, title string")
    return academic.execute(plans, _rows(spark), web)


EXECUTE = "SELECT * FROM " + values_sql([(1, 1, "RAG", "arxiv"), (1, 2, "Dense Retrieval", "semantic_scholar"), (1, 3, "Sparse", "semantic_scholar"), (2, 1, "Ada Lovelace", "semantic_author"), (3, 1, "The paper", "semantic_detail"), (3, 2, "Ref one", "semantic_references"), (4, 1, "web 4.1", "web_search"), (4, 2, "web 4.2", "web_search"), (5, 1, "web 5.1", "web_search"), (5, 2, "web 5.2", "web_search")], "query_id, place, title, source")


def academic_query_words(spark, sf):
    rows = spark.createDataFrame([(1, "查找作者 Yann LeCun 的论文"), (2, "推荐类似 Attention is all you need 的论文"), (3, "作者"), (4, "related papers of RAG")], "query_id int, text string")
    return academic.author_query(rows).withColumnRenamed("cleaned", "author").join(rows.select("query_id", academic.strip_relations(F.col("text")).alias("plain"), academic.endpoint(F.when(F.col("query_id") == 1, "author_search").when(F.col("query_id") == 2, "paper_recommendations").otherwise("x")).alias("endpoint")), "query_id")


QUERY_WORDS = "SELECT * FROM " + values_sql([(1, "Yann LeCun", "作者 Yann LeCun", "/graph/v1/author/search"), (2, "推荐类似 Attention is all you need", "Attention is all you need", "/recommendations/v1/papers/forpaper/{paper_id}"), (3, "作者", "作者", "/graph/v1/paper/search"), (4, "related papers of RAG", "of RAG", "/graph/v1/paper/search")], "query_id, author, plain, endpoint")

QUERIES = {f.__name__: f for f in (noise_headings, noise_labels, toc_headings, toc_match, pdf_lines, pdf_parse_scores, pdf_good_enough, pdf_layout_decision, section_scores, reference_fields, academic_normalise, academic_union, academic_resolve, academic_execute, academic_query_words)}
ORACLES = {"noise_headings": NOISE, "noise_labels": NOISE_LABELS, "toc_headings": TOC, "toc_match": TOC_MATCH, "pdf_lines": PDF_LINES, "pdf_parse_scores": PARSE_SCORES, "pdf_good_enough": GOOD, "pdf_layout_decision": DECISION, "section_scores": SECTION_SCORES, "reference_fields": REFERENCES, "academic_normalise": NORMALISE, "academic_union": UNION, "academic_resolve": RESOLVE, "academic_execute": EXECUTE, "academic_query_words": QUERY_WORDS}
