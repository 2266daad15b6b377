"""Parsing and memory queries with their DuckDB twins where regular expressions suffice."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_engine.operators import memory as mem
from evidence_engine.operators import parsing as ps
from evidence_engine.operators import segments
from evidence_engine.operators.sections import section_type_sql
from evidence_engine.functions.text import scaled, strip
from evidence_engine.sources.literals import values_sql
from evidence_engine.sources.scratch import parts_for, scratch_path
from evidence_engine.sources.tables import chunks, messages, read, with_ctes

# Literal papers and references of our own.
PAPERS = [
    (1, "notes", "# Sparse Attention for Long Texts\nAda Lovelace, Alan Turing\n2021\narXiv:2101.00001v2\n\n## Abstract\nWe study long texts. doi 10.1234/abc.5\n\n## 1. Introduction\nText one.\n\n## 2 Method\nMethod: Sparse Window Net uses blocks.\n\n```python\nx = 1\n```\n\n## 3 Experiments\nDataset: WMT14 English\nBLEU and F1 rise; BLEU again.\n\n| Model | BLEU |\n| --- | --- |\n| A | 30 |\n\n## References\n[1] Doe J. First work. 2019.\n[2] Roe K. Second. doi:10.5555/x.y 2020."),
    (2, "开题", "# 面向医学问答的检索增强\n\n## 摘要\n本文研究检索。\n\n## 第一章 绪论\n背景。\n\n## 三、方法\n提出HyRAG方法，数据集：CMedQA2\n\n## （五）结论\n准确率提升。"),
    (3, "plain", "no headings at all\njust two lines and 1999"),
    (4, "empty", ""),
]
REFS = [
    (1, "【类型】reference\n【内容】\n[1] Vaswani A., Shazeer N. Attention is all you need. NeurIPS 2017. arXiv:1706.03762\n[2] Lewis P. et al. Retrieval-augmented generation. 2020. doi:10.1000/rag.7.\n3. Guu K. REALM. 2020."),
    (2, "Doe 2001. A title.\nRoe 2002 2003. Another title."), (3, "[7] Only one entry 1998, revised 2004."), (4, ""),
]
HEADING_PAIRS = [(1, "1 Introduction", "Introduction"), (2, "Related Work ..... 12", "related work"), (3, "Method overview", "Method"), (4, "Experiments and results", "Experiments and results on data"), (5, "方法", "方法 概述"), (6, "", "x"), (7, "Deep nets", "Shallow trees")]
LINES = [(d, p, t) for d in (1, 2) for p in range(1, 6 if d == 1 else 3) for t in (f"Journal of Things {p}", f"body {d} {'abc'[p % 3]}", "Vol" if p < 4 else "Vox")]
SECTIONS = [(1, "A / B / C"), (1, "A / D"), (2, "X"), (2, "X / Y"), (3, "")]
_LINES = values_sql(LINES, "doc_id, page, text")


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def language_detect(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text").unionByName(_frame(spark, PAPERS, "doc_id long, title string, text string").select(-F.col("doc_id"), "text").toDF("doc_id", "text"))
    return docs.select("doc_id", ps.language(F.col("text")).alias("language"))


_DOCS_AND_PAPERS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM {values_sql(PAPERS, 'doc_id, title, text')})"
LANGUAGE = f"SELECT doc_id, CASE WHEN zh > 0 AND zh * 5 >= en THEN 'zh' WHEN en > 0 THEN 'en' ELSE 'unknown' END AS language FROM (SELECT doc_id, len(regexp_extract_all(text, '[一-鿿]')) AS zh, len(regexp_extract_all(text, '[A-Za-z]')) AS en FROM {_DOCS_AND_PAPERS})"


def paper_metadata(spark, sf):
    docs = _frame(spark, PAPERS, "doc_id long, title string, content string")
    more = read(spark, sf, "documents").select("doc_id", "source", "text").select((F.col("doc_id") + 10).alias("doc_id"), F.col("source").alias("title"), F.col("text").alias("content"))
    return ps.paper_metadata(docs.unionByName(more)).select("doc_id", "paper_title", "arxiv_id", "doi", "year")


PAPER_META = f"""WITH d AS (SELECT doc_id, title, text FROM {values_sql(PAPERS, 'doc_id, title, text')} UNION ALL SELECT doc_id + 10, source, text FROM documents),
l AS (SELECT doc_id, title, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM d),
h AS (SELECT *, array_to_string(ls[1:30], chr(10)) AS head, list_filter(ls, lambda x: starts_with(x, '#')) AS hs FROM l)
SELECT doc_id, CASE WHEN len(hs) > 0 THEN regexp_replace(regexp_replace(hs[1], '^[# ]+', ''), '^\\s+|\\s+$', '', 'g') ELSE title END AS paper_title, regexp_extract(head, '(?i)arXiv[:：]?[ ]*([0-9]{{4}}[.][0-9]{{4,5}}(?:v[0-9]+)?)', 1) AS arxiv_id,
  regexp_extract(head, '(?:^|[^0-9A-Za-z_])(10[.][0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+)', 1) AS doi, regexp_extract(head, '(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{{2}})(?:$|[^0-9A-Za-z_])', 1) AS year FROM h"""


def _paper_blocks(spark, sf):
    """Blocks of the literal papers and of all documents."""
    papers = _frame(spark, PAPERS, "doc_id long, title string, content string").select("doc_id", "content")
    return ps.blocks_of(papers.unionByName(read(spark, sf, "documents").select((F.col("doc_id") + 10).alias("doc_id"), F.col("text").alias("content"))))


def _document_blocks(spark, sf):
    return ps.blocks_of(read(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))


def markdown_blocks(spark, sf):
    return _document_blocks(spark, sf).select("doc_id", "pos", "type", "text", "section_path", "level")


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[\t ]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
# A fold: one line of every document a step.
_FOLD = rf"""l AS (SELECT doc_id, string_split({_NORMAL}, chr(10)) AS ls FROM texts),
f AS (
  SELECT doc_id, ls, 0 AS i, false AS code, []::VARCHAR[] AS path, '' AS kind, 0 AS island, 0 AS level, NULL::VARCHAR AS line FROM l
  UNION ALL
  SELECT doc_id, ls, i + 1, CASE WHEN fence THEN NOT code ELSE code END, CASE WHEN now = 'heading' THEN path[1:size - 1] || [title] ELSE path END, now,
    island + CASE WHEN (fence AND NOT code) OR now <> kind OR now = 'heading' THEN 1 ELSE 0 END, CASE WHEN now = 'heading' THEN size ELSE 0 END,
    CASE WHEN fence THEN NULL WHEN now = 'heading' THEN title ELSE b END
  FROM (
    SELECT *, CASE WHEN code OR fence THEN 'code' WHEN size > 0 THEN 'heading' WHEN starts_with(b, '|') AND ends_with(b, '|') AND b <> '|' THEN 'table' WHEN b <> '' THEN 'paragraph' ELSE '' END AS now
    FROM (
      SELECT *, starts_with(b, '```') AS fence, length(regexp_extract(b, '^(#{{1,6}})\s+[^\n]+$', 1)) AS size, regexp_extract(b, '^#{{1,6}}\s+([^\n]+)$', 1) AS title
      FROM (SELECT *, regexp_replace(ls[i + 1], '^\s+|\s+$', '', 'g') AS b FROM f WHERE i < len(ls))))),
g AS (
  SELECT doc_id, island, any_value(kind) AS kind, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS text, any_value(array_to_string(path, ' / ')) AS section_path, max(level) AS level
  FROM f WHERE kind <> '' GROUP BY doc_id, island),
b AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS INTEGER) AS pos, CASE WHEN kind = 'paragraph' THEN {section_type_sql('section_path', 'text')} ELSE kind END AS type,
    text, section_path, CAST(level AS INTEGER) AS level FROM g WHERE text <> '')
"""
_BLOCKS = "WITH RECURSIVE texts AS (SELECT doc_id, text FROM documents)," + _FOLD
BLOCKS = _BLOCKS + "SELECT * FROM b"


def markdown_report(spark, sf):
    """Every order as a Markdown report of headings, a table of its lines and a fenced note, and the blocks of these."""
    line = F.concat(F.lit("| "), F.col("l_linenumber").cast("string"), F.lit(" | "), F.col("l_partkey").cast("string"), F.lit(" |"))
    items = read(spark, sf, "lineitem")
    # Lists of lines take more room than lines, so they are made in partitions by the table's bytes.
    items = items.withColumnRenamed("l_orderkey", "o_orderkey").repartition(parts_for(items, segments.PART_BYTES), "o_orderkey")
    lines = items.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("rows"))
    table = F.array_join(F.transform("rows", lambda x: x.line), "\n")
    heads = F.concat(F.lit("# Order "), F.col("o_orderkey").cast("string"), F.lit("\n## Method\nstatus "), F.col("o_orderstatus"), F.lit("\nsecond line\n### Lines\n"))
    rest = F.concat(F.lit("\n```text\n# "), F.col("o_orderpriority"), F.lit("\n```\n## 2. References\nnone"))
    orders = read(spark, sf, "orders").join(lines, "o_orderkey", "left")
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(heads, F.coalesce(table, F.lit("")), rest).alias("content"))
    return ps.blocks_of(docs).select("doc_id", "pos", "type", "text", "section_path", "level")


REPORT = """WITH RECURSIVE lines AS (SELECT l_orderkey, string_agg('| ' || l_linenumber || ' | ' || l_partkey || ' |', chr(10) ORDER BY l_linenumber, '| ' || l_linenumber || ' | ' || l_partkey || ' |') AS rows FROM lineitem GROUP BY l_orderkey),
texts AS (
  SELECT o_orderkey AS doc_id, array_to_string(['# Order ' || o_orderkey, '## Method', 'status ' || o_orderstatus, 'second line', '### Lines', coalesce(rows, ''), '```text', '# ' || o_orderpriority, '```', '## 2. References', 'none'], chr(10)) AS text
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey),
""" + _FOLD + "SELECT * FROM b"


def type_aware_chunks(spark, sf):
    return ps.chunks_of(_paper_blocks(spark, sf), size=300, overlap=40)


def section_infer(spark, sf):
    return _document_blocks(spark, sf).select("doc_id", "section_path").distinct().withColumn("section", ps.section_type(F.col("section_path"), F.lit("")))


SECTIONS_INFERRED = _BLOCKS + f"SELECT DISTINCT doc_id, section_path, {section_type_sql('section_path', repr(''))} AS section FROM b"


def method_dataset_metric(spark, sf):
    return ps.method_dataset_metric(_paper_blocks(spark, sf))


def pdf_quality(spark, sf):
    return ps.parse_quality(_paper_blocks(spark, sf))


def html_blocks(spark, sf):
    return ps.blocks_of(read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("content")), "html").groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("type") == "heading").alias("headings"))


def html_strip(spark, sf):
    return read(spark, sf, "pages").select("page_id", ps.strip_html(F.col("html")).alias("text"))


HTML_STRIP = r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages"


def html_tables(spark, sf):
    found = F.regexp_extract_all("html", F.lit("(?is)<table.*?</table>"), F.lit(0))
    return read(spark, sf, "pages").select("page_id", F.size(found).alias("tables"), F.size(F.regexp_extract_all("html", F.lit("(?is)<li[^>]*>.*?</li>"), F.lit(0))).alias("items"))


HTML_TABLES = "SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<table.*?</table>')) AS INTEGER) AS tables, CAST(len(regexp_extract_all(html, '(?is)<li[^>]*>.*?</li>')) AS INTEGER) AS items FROM pages"


def crawl_text(spark, sf):
    """Pages long enough to keep, each line once."""
    lines = F.array_distinct(F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style|nav|footer|head)[^>]*>.*?</(script|style|nav|footer|head)>", "\n"), "<[^>]*>", "\n"), r"\n+"), strip), lambda x: x != ""))
    out = read(spark, sf, "pages").select("page_id", lines.alias("l")).select("page_id", F.size("l").alias("lines"), F.array_join("l", "\n").alias("text"))
    return out.where(F.length("text") >= 1200)


CRAWL = r"""WITH s AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|footer|head)[^>]*>.*?</(script|style|nav|footer|head)>', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM pages),
u AS (SELECT page_id, line, min(i) AS i FROM (SELECT page_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM s) GROUP BY page_id, line)
SELECT page_id, CAST(count(*) AS INTEGER) AS lines, string_agg(line, chr(10) ORDER BY i) AS text FROM u GROUP BY page_id HAVING length(string_agg(line, chr(10) ORDER BY i)) >= 1200"""


def reference_split(spark, sf):
    return ps.split_references(_frame(spark, REFS, "ref_id long, text string"))


def paper_citations(spark, sf):
    return ps.citation_edges(ps.split_references(_frame(spark, REFS, "ref_id long, text string")))


# By hand: entries of the literal lists with their label, identifiers and last year, and what each cites.
_SPLIT = [
    (1, 0, "[1] Vaswani A., Shazeer N. Attention is all you need. NeurIPS 2017. arXiv:1706.03762", "1", "", "1706.03762", "2017"), (1, 1, "[2] Lewis P. et al. Retrieval-augmented generation. 2020. doi:10.1000/rag.7.", "2", "10.1000/rag.7", "", "2020"), (1, 2, "3. Guu K. REALM. 2020.", "3", "", "", "2020"),
    (2, 0, "Doe 2001. A title.", "", "", "", "2001"), (2, 1, "Roe 2002 2003. Another title.", "", "", "", "2003"), (3, 0, "[7] Only one entry 1998, revised 2004.", "7", "", "", "2004"),
]
REFERENCE_SPLIT = f"SELECT CAST(ref_id AS BIGINT) AS ref_id, pos, raw, label, doi, arxiv_id, year FROM {values_sql(_SPLIT, 'ref_id, pos, raw, label, doi, arxiv_id, year')}"
PAPER_CITATIONS = "SELECT CAST(ref_id AS BIGINT) AS ref_id, target, 'PAPER_CITES_PAPER' AS relation FROM " + values_sql([(r[0], f"arxiv:{r[5]}" if r[5] else f"doi:{r[4]}" if r[4] else r[2]) for r in _SPLIT], "ref_id, target")


def heading_similarity(spark, sf):
    return _frame(spark, HEADING_PAIRS, "pair_id long, a string, b string").select("pair_id", scaled(ps.heading_similarity(F.col("a"), F.col("b"))).alias("similarity"))


_KEY = "regexp_replace(regexp_replace(lower({0}), '[·.。．…\\s]+[0-9]+$', ''), '[^0-9a-z一-鿿]+', '', 'g')"
HEADING_SIM = f"""WITH k AS (SELECT pair_id, {_KEY.format('a')} AS x, {_KEY.format('b')} AS y FROM {values_sql(HEADING_PAIRS, 'pair_id, a, b')}),
t AS (SELECT *, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l, list_distinct(regexp_extract_all(x, '[a-z0-9]+|[一-鿿]')) AS p, list_distinct(regexp_extract_all(y, '[a-z0-9]+|[一-鿿]')) AS q FROM k)
SELECT CAST(pair_id AS BIGINT) AS pair_id, CAST(floor(CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 WHEN length(s) >= 8 AND starts_with(l, s) THEN length(s)::DOUBLE / length(l) WHEN len(p) = 0 OR len(q) = 0 THEN 0 ELSE len(list_intersect(p, q))::DOUBLE / len(list_distinct(list_concat(p, q))) END * 1e6 + 0.5) AS BIGINT) AS similarity FROM t"""


def repeated_lines(spark, sf):
    return ps.repeated_lines(_frame(spark, LINES, "doc_id int, page int, text string"))


REPEATED = f"""WITH k AS (SELECT doc_id, page, regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[^a-z#一-鿿]+', '', 'g') AS key FROM {_LINES}), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM {_LINES} GROUP BY doc_id),
s AS (SELECT doc_id, key, count(DISTINCT page) AS on_pages FROM k WHERE length(key) >= 4 GROUP BY doc_id, key)
SELECT doc_id, key, on_pages AS "on" FROM s JOIN p USING (doc_id) WHERE pages >= 3 AND on_pages >= greatest(3, floor(pages * 35 / 100))"""


def section_tree(spark, sf):
    return ps.section_tree(_frame(spark, SECTIONS, "doc_id int, section_path string"))


SECTION_TREE = f"""WITH p AS (SELECT doc_id, list_transform(string_split(section_path, '/'), lambda x: trim(x)) AS ps FROM {values_sql(SECTIONS, 'doc_id, section_path')} WHERE section_path <> ''),
i AS (SELECT *, unnest(range(1, len(ps) + 1)) AS n FROM p)
SELECT DISTINCT doc_id, array_to_string(ps[1:n - 1], ' / ') AS parent, array_to_string(ps[1:n], ' / ') AS child FROM i"""


def chunk_chain_edges(spark, sf):
    return ps.chunk_chain(chunks(spark, sf))


CHAIN = with_ctes("chunks", """, p AS (SELECT lag(chunk_id) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS a, chunk_id AS b FROM chunks)
SELECT a AS source, b AS target, 'NEXT_CHUNK' AS relation FROM p WHERE a IS NOT NULL UNION ALL SELECT b, a, 'PREV_CHUNK' FROM p WHERE a IS NOT NULL""")


def doc_id_merge(spark, sf):
    """By language, the documents that mention a licence, and behind them those that hold an address."""
    docs = read(spark, sf, "documents").select("doc_id", "lang", F.col("text").ilike("%licen_e%").alias("a"), F.contains("text", F.lit("@")).alias("b"))
    ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("doc_id"))))
    lists = docs.groupBy("lang").agg(ids(F.col("a")).alias("x"), ids(F.col("b")).alias("y"))
    return lists.select("lang", F.array_join(F.transform(F.array_union("x", "y"), lambda d: d.cast("string")), ",").alias("docs"))


DOC_MERGE = """WITH u AS (SELECT lang, doc_id, min(k) AS k FROM (SELECT lang, doc_id, 0 AS k FROM documents WHERE text ILIKE '%licen_e%' UNION ALL SELECT lang, doc_id, 1 FROM documents WHERE contains(text, '@')) GROUP BY lang, doc_id)
SELECT l.lang, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k, doc_id), '') AS docs FROM (SELECT DISTINCT lang FROM documents) l LEFT JOIN u USING (lang) GROUP BY l.lang"""


def header_parse(spark, sf):
    made = chunks(spark, sf).select("chunk_id", F.concat(F.lit("【论文】 "), "source", F.lit("\n【类型】paragraph\n【年份】"), (F.col("doc_id") % 30 + 1990).cast("string"), F.lit("\n【正文】\n"), "content").alias("content"))
    return made.select("chunk_id", *ps.header_fields(F.col("content"), {"paper_title": "论文", "chunk_type": "类型", "year": "年份", "metric": "指标"}))


HEADERS = with_ctes("chunks", "SELECT chunk_id, source AS paper_title, 'paragraph' AS chunk_type, CAST(doc_id % 30 + 1990 AS VARCHAR) AS year, '' AS metric FROM chunks")


# Memory


def recent_turns(spark, sf):
    return mem.recent_turns(messages(spark, sf)).select("conv_id", "turn", "role", "content")


RECENT = with_ctes("msgs", "SELECT conv_id, turn, role, content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS b FROM msgs) WHERE b <= 8")


def conv_list(spark, sf):
    return mem.conversations(messages(spark, sf)).orderBy(F.desc("conv_id")).limit(20)


CONV_LIST = with_ctes("msgs", "SELECT conv_id, count(*) // 2 AS rounds, substring(coalesce(arg_min(content, turn) FILTER (WHERE role = 'user'), ''), 1, 50) AS title, CAST(sum(length(content)) AS BIGINT) AS chars FROM msgs GROUP BY conv_id ORDER BY conv_id DESC LIMIT 20")


def compress_trigger(spark, sf):
    m = messages(spark, sf)
    return mem.due_for_compression(m, m.where("conv_id % 2 = 0").groupBy("conv_id").agg(F.least(F.count("*"), F.lit(4)).alias("covered")))


COMPRESS = with_ctes("msgs", """, c AS (SELECT conv_id, least(count(*), 4) AS covered FROM msgs WHERE conv_id % 2 = 0 GROUP BY conv_id),
n AS (SELECT m.*, coalesce(covered, 0) AS done, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS no FROM msgs m LEFT JOIN c USING (conv_id)),
a AS (SELECT conv_id, max(done) AS from_message, count(*) AS to_message, CAST(coalesce(sum(CASE WHEN no > done THEN length(content) END), 0) AS BIGINT) AS chars FROM n GROUP BY conv_id)
SELECT *, NOT (to_message < 8 AND to_message - from_message < 4 AND chars < 2500) AS due FROM a""")


def fallback_summary(spark, sf):
    return mem.fallback_summary(messages(spark, sf))


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
SUMMARY = with_ctes("msgs", f""", r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS b FROM msgs)
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || substring({_STRIP.format('content')}, 1, 180), chr(10) ORDER BY turn, role) AS summary FROM r WHERE b <= 8 GROUP BY conv_id""")


def fallback_items(spark, sf):
    return mem.fallback_items(messages(spark, sf)).select("conv_id", "item_no", "turn", "summary", F.array_join("keywords", " ").alias("keywords"))


_ITEMS = f""", it AS (SELECT conv_id, turn, content, substring({_STRIP.format('content')}, 1, 220) AS summary, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS item_no FROM msgs WHERE role = 'user' AND length({_STRIP.format('content')}) >= 4),
items AS (SELECT * FROM it WHERE item_no <= 6)"""
ITEMS = with_ctes("msgs", _ITEMS + """, w AS (SELECT conv_id, item_no, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM (SELECT conv_id, item_no, regexp_extract_all(content, '[一-龥A-Za-z0-9]{2,}')[1:12] AS ws FROM items)),
k AS (SELECT conv_id, item_no, string_agg(x, ' ' ORDER BY i) AS keywords FROM (SELECT conv_id, item_no, x, min(i) AS i FROM w GROUP BY ALL) GROUP BY ALL)
SELECT items.conv_id, CAST(items.item_no AS INTEGER) AS item_no, turn, summary, coalesce(keywords, '') AS keywords FROM items LEFT JOIN k ON k.conv_id = items.conv_id AND k.item_no = items.item_no""")


def memory_recall(spark, sf):
    """Each conversation's last user message asks for its items."""
    m = messages(spark, sf)
    last = m.where("role = 'user'").groupBy("conv_id").agg(F.max_by("content", "turn").alias("text")).withColumn("query_id", F.col("conv_id"))
    return mem.recall(last, mem.fallback_items(m))


RECALL = with_ctes("msgs", _ITEMS + """, q AS (SELECT conv_id, regexp_extract_all(arg_max(content, turn), '[一-龥A-Za-z0-9]{2,}')[1:12] AS ts FROM msgs WHERE role = 'user' GROUP BY conv_id),
m AS (SELECT items.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM items JOIN q USING (conv_id) WHERE len(list_filter(ts, lambda x: contains(lower(content), lower(x)))) > 0)
SELECT conv_id AS query_id, CAST(rank AS INTEGER) AS rank, conv_id, CAST(item_no AS INTEGER) AS item_no FROM m WHERE rank <= 6""")


def topic_upsert(spark, sf):
    t = messages(spark, sf).select("conv_id", F.col("role").alias("label"), (F.col("turn") % 2).alias("turn"), "content", F.col("turn").alias("seq"))
    return mem.upsert_topics(t)


TOPICS = with_ctes("msgs", "SELECT conv_id, role AS label, turn % 2 AS turn, arg_max(content, (length(content), -turn)) AS content FROM msgs GROUP BY conv_id, role, turn % 2")


def memory_context(spark, sf):
    m = messages(spark, sf)
    return mem.context(m, mem.fallback_items(m))


MEMORY_CONTEXT = with_ctes("msgs", _ITEMS + f""", r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS b FROM msgs),
s AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || substring({_STRIP.format('content')}, 1, 180), chr(10) ORDER BY turn, role) AS summary FROM r WHERE b <= 8 GROUP BY conv_id),
f AS (SELECT conv_id, string_agg('- ' || summary, chr(10) ORDER BY item_no) AS facts FROM items GROUP BY conv_id)
SELECT s.conv_id, substring('Summary:' || chr(10) || summary || coalesce(chr(10) || chr(10) || 'Memory:' || chr(10) || facts, ''), 1, 900) AS prompt FROM s LEFT JOIN f USING (conv_id)""")


_LOCKS = [(1, "running", 10), (2, "running", 400), (3, "done", 5), (4, None, None), (5, "running", None)]


def summary_lock(spark, sf):
    return mem.may_summarise(_frame(spark, _LOCKS, "conv_id int, status string, age_s int"))


LOCK = f"SELECT conv_id, NOT coalesce(status = 'running' AND coalesce(age_s, 0) < 300, false) AS free FROM {values_sql(_LOCKS, 'conv_id, status, age_s')}"


def memory_merge(spark, sf):
    """Recall by place and by length, as two lists of scores."""
    m = messages(spark, sf)
    a = m.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("item_id"), (F.lit(1000) - F.col("turn")).alias("score"))
    b = m.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("item_id"), F.length("content").cast("long").alias("score"))
    return mem.merge_recall(a.unionByName(b))


MEMORY_MERGE = with_ctes("msgs", """, l AS (SELECT conv_id AS query_id, turn AS item_id, 1000 - turn AS score FROM msgs UNION ALL SELECT conv_id, turn, length(content) FROM msgs),
b AS (SELECT query_id, item_id, max(score) AS score FROM l GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM b) WHERE rank <= 6""")

_TALK = [(1, 1, "assistant", "建议如下\n方向一：检索增强\n细节 A\n方向2 图谱\n细节 B"), (1, 2, "user", "选题1怎么样"), (1, 3, "assistant", "### 方向一：检索增强\n更长的细节 A 与数据"), (2, 1, "assistant", "no topics")]


def topic_extract(spark, sf):
    return mem.topics(_frame(spark, _TALK, "conv_id long, turn long, role string, content string"))


TOPIC_EXTRACT = "SELECT CAST(conv_id AS BIGINT) AS conv_id, label, CAST(turn AS BIGINT) AS turn, content, seq FROM " + values_sql([(1, "1", 1, "方向一：检索增强\n细节 A", 1), (1, "2", 1, "方向2 图谱\n细节 B", 3), (1, "1", 3, "### 方向一：检索增强\n更长的细节 A 与数据", 0)], "conv_id, label, turn, content, seq")


def topic_reference(spark, sf):
    talk = _frame(spark, _TALK, "conv_id long, turn long, role string, content string")
    asked = talk.where("role = 'user'").select(F.col("turn").alias("query_id"), "conv_id", F.col("content").alias("text"))
    return mem.referenced_topic(asked, mem.upsert_topics(mem.topics(talk)))


TOPIC_REFERENCE = "SELECT CAST(query_id AS BIGINT) AS query_id, label, content FROM " + values_sql([(2, "1", "### 方向一：检索增强\n更长的细节 A 与数据")], "query_id, label, content")


def focus_state(spark, sf):
    return mem.focus_states(messages(spark, sf))


def stream_memory_state(spark, sf):
    """The same focus states by the streaming operator, over the messages' file as a stream that ends."""
    from evidence_engine.streaming.memory import FOCUS, run_over

    at = scratch_path(spark, "focus")
    # All messages of a conversation in one file, so that they come in one micro-batch, in order.
    read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").repartition(4, "conv_id").write.parquet(f"{at}/in")
    run_over(spark, f"{at}/in", f"{at}/out", f"{at}/state")
    return spark.read.schema(FOCUS).parquet(f"{at}/out")


QUERIES = {f.__name__: f for f in (language_detect, paper_metadata, markdown_blocks, markdown_report, type_aware_chunks, section_infer, method_dataset_metric, pdf_quality, html_blocks, html_strip, html_tables, crawl_text, reference_split, paper_citations, heading_similarity, repeated_lines, section_tree, chunk_chain_edges, doc_id_merge, header_parse, recent_turns, conv_list, compress_trigger, fallback_summary, fallback_items, memory_recall, topic_upsert, memory_context, summary_lock, memory_merge, topic_extract, topic_reference, focus_state, stream_memory_state)}
ORACLES = {
    "markdown_blocks": BLOCKS, "markdown_report": REPORT, "section_infer": SECTIONS_INFERRED, "language_detect": LANGUAGE, "paper_metadata": PAPER_META, "html_strip": HTML_STRIP, "html_tables": HTML_TABLES, "crawl_text": CRAWL, "heading_similarity": HEADING_SIM, "repeated_lines": REPEATED, "section_tree": SECTION_TREE, "chunk_chain_edges": CHAIN,
    "reference_split": REFERENCE_SPLIT, "paper_citations": PAPER_CITATIONS, "topic_extract": TOPIC_EXTRACT, "topic_reference": TOPIC_REFERENCE, "doc_id_merge": DOC_MERGE, "header_parse": HEADERS, "recent_turns": RECENT, "conv_list": CONV_LIST, "compress_trigger": COMPRESS, "fallback_summary": SUMMARY, "fallback_items": ITEMS, "memory_recall": RECALL, "topic_upsert": TOPICS, "memory_context": MEMORY_CONTEXT, "summary_lock": LOCK, "memory_merge": MEMORY_MERGE,
}
