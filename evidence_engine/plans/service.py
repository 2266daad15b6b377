"""Queries of stored tables, answers and workflows; literal inputs with answers worked out by hand, or DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_engine.operators import answers, catalog, parsing, workflow
from evidence_engine.operators import routing as r
from evidence_engine.operators.memory import fallback_items
from evidence_engine.plans import api
from evidence_engine.plans.graphs import PAPER_EDGES, PAPER_NODES, _paper_graph
from evidence_engine.sources import files, literals
from evidence_engine.sources.literals import values_sql
from evidence_engine.sources.tables import graph_nodes, messages, questions, questions_sql, read, with_ctes


def _docs(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"), "source")


# Stored tables


def documents_list(spark, sf):
    out = catalog.list_documents(_docs(spark, sf), words="the", source="src1", offset=1, limit=10)
    return out.select("doc_id", F.length("content").alias("chars"), "total")


DOCUMENTS_LIST = "WITH m AS (SELECT * FROM documents WHERE (source ILIKE '%the%' OR text ILIKE '%the%') AND source = 'src1') SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, (SELECT count(*) FROM m) AS total FROM m ORDER BY doc_id DESC LIMIT 10 OFFSET 1"


def documents_get(spark, sf):
    """Documents by id with the nodes that name them; an id that isn't there has no row."""
    nodes = graph_nodes(spark, sf).where("type = 'region'").withColumn("source_doc_ids", F.array(F.col("node_id"), F.col("node_id") + 1))
    keys = spark.createDataFrame([(0,), (1,), (5,), (7,), (-4,)], "doc_id long")
    return catalog.get_documents(_docs(spark, sf), keys, nodes).select("doc_id", F.length("content").alias("chars"), "nodes")


DOCUMENTS_GET = with_ctes("g_nodes", """, n AS (SELECT name, unnest([node_id, node_id + 1]) AS doc_id FROM g_nodes WHERE type = 'region')
SELECT d.doc_id, CAST(length(text) AS INTEGER) AS chars, coalesce(string_agg(name, ',' ORDER BY name), '') AS nodes FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id WHERE d.doc_id IN (0, 1, 5, 7, -4) GROUP BY d.doc_id, text""")


def nodes_update(spark, sf):
    nodes = graph_nodes(spark, sf).select("node_id", "name", "type", F.lit("old").alias("description"))
    changes = nodes.where("type = 'nation'").select("node_id", F.when(F.col("node_id") % 2 == 0, F.concat("name", F.lit("!"))).alias("name"), F.when(F.col("node_id") % 3 == 0, F.lit("new")).alias("description"))
    return catalog.update_nodes(nodes, changes).where("type in ('nation', 'region')")


NODES_UPDATE = with_ctes("g_nodes", "SELECT node_id, CASE WHEN type = 'nation' AND node_id % 2 = 0 THEN name || '!' ELSE name END AS name, type, CASE WHEN type = 'nation' AND node_id % 3 = 0 THEN 'new' ELSE 'old' END AS description FROM g_nodes WHERE type IN ('nation', 'region')")


def nodes_create(spark, sf):
    """Nodes put behind those that are there, twice the same: names may repeat."""
    nodes = graph_nodes(spark, sf).where("type = 'region'").select("node_id", "name", "type")
    fresh = nodes.select(F.col("node_id").alias("seq"), "name", "type")
    return catalog.create_nodes(catalog.create_nodes(nodes, fresh), fresh.withColumn("seq", F.col("seq") + 100)).groupBy("name", "type").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("ids"))


NODES_CREATE = "SELECT r_name AS name, 'region' AS type, CAST(3 AS BIGINT) AS n, CAST(3 AS BIGINT) AS ids FROM region"


def store_documents(spark, sf):
    """Chunks and vectors of documents without a graph, and what is left when every third document goes with both."""
    docs = read(spark, sf, "documents").select("doc_id", "source", "text")
    chunks, vectors = catalog.store_documents(docs)
    left = catalog.delete_documents(docs.where("doc_id % 3 = 0").select("doc_id"), docs, chunks, vectors)
    count = lambda df, kind, which: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(which).alias("which"), "n")
    out = count(chunks, "chunks", "all").unionByName(count(vectors, "vectors", "all"))
    for df, kind in zip(left, ("documents", "chunks", "vectors"), strict=True):
        out = out.unionByName(count(df, kind, "left"))
    return out


STORE = with_ctes("chunks", "SELECT 'chunks' AS kind, 'all' AS which, count(*) AS n FROM chunks UNION ALL SELECT 'vectors', 'all', count(*) FROM chunks UNION ALL SELECT 'documents', 'left', count(*) FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'chunks', 'left', count(*) FROM chunks WHERE doc_id % 3 <> 0 UNION ALL SELECT 'vectors', 'left', count(*) FROM chunks WHERE doc_id % 3 <> 0")


def edges_delete(spark, sf):
    _, edges = _paper_graph(spark)
    return catalog.delete_edges(edges, spark.createDataFrame([(2,), (9,), (77,)], "edge_id long")).select("edge_id", "relation")


EDGES_DELETE = f"SELECT CAST(edge_id AS BIGINT) AS edge_id, relation FROM {values_sql([(e, k) for e, _, _, k, _ in PAPER_EDGES], 'edge_id, relation')} WHERE edge_id NOT IN (2, 9)"


def nodes_of_document(spark, sf):
    """A predicate on a list within a row, and one on a path of a row's properties."""
    nodes, _ = _paper_graph(spark)
    return nodes.where(F.array_contains("source_doc_ids", F.lit(11)) | (F.expr("try_cast(properties['document_id'] AS BIGINT)") == 11)).select("node_id", "name")


NODES_OF_DOCUMENT = f"SELECT CAST(node_id AS BIGINT) AS node_id, name FROM {values_sql([(n, name) for n, name, _, doc, ids in PAPER_NODES if doc == 11 or 11 in ids], 'node_id, name')}"


def events_json_path(spark, sf):
    """Events by a number in their JSON properties, by hour."""
    e = read(spark, sf, "events").withColumn("k", catalog.json_number(F.col("props"), "$.k"))
    return e.where("k >= 50").groupBy(F.date_format("ts", "yyyy-MM-dd'T'HH").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max(catalog.iso(F.col("ts"))).alias("last"))


EVENTS_JSON = "SELECT strftime(ts, '%Y-%m-%dT%H') AS hour, event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS total, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS last FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k >= 50 GROUP BY ALL"

_REPLIES = [(1, '```json\n{"a": 1, "b": [2]}\n```'), (2, 'Here it is: {"a": 3} as asked.'), (3, "no object"), (4, "{broken"), (5, '{"a": {"c": 5}}')]


def reply_json(spark, sf):
    rows = spark.createDataFrame(_REPLIES, "k int, reply string").withColumn("j", catalog.fenced_json(F.col("reply")))
    return rows.select("k", F.get_json_object("j", "$.a").alias("a"), F.url_encode("reply").alias("quoted"))


REPLY_JSON = "SELECT k, a, replace(url_encode(reply), '%20', '+') AS quoted FROM " + values_sql([(k, t, a) for (k, t), a in zip(_REPLIES, ("1", "3", None, None, '{"c":5}'), strict=True)], "k, reply, a")

# Conversations


def conversation_append(spark, sf):
    """A question and an answer behind the first conversations, and a new one."""
    m = messages(spark, sf)
    turns = spark.createDataFrame([(0, "what?", "that"), (1, "and?", "this"), (1_000_000, "hello", "hi")], "conv_id long, question string, answer string")
    return catalog.append_turns(m, turns).where("conv_id in (0, 1, 1000000)").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last"), F.max_by("content", "turn").alias("said"))


CONV_APPEND = with_ctes("msgs", """, t AS (SELECT * FROM (VALUES (0, 'that'), (1, 'this'), (1000000, 'hi')) t(conv_id, said)), m AS (SELECT conv_id, count(*) AS n, max(turn) AS last FROM msgs GROUP BY conv_id)
SELECT CAST(t.conv_id AS BIGINT) AS conv_id, coalesce(n, 0) + 2 AS n, CAST(coalesce(last, -1) + 2 AS BIGINT) AS last, said FROM t LEFT JOIN m USING (conv_id)""")


def conversation_detail(spark, sf):
    return catalog.conversation_detail(messages(spark, sf), spark.createDataFrame([(0,), (3,), (999_999,)], "conv_id long"))


CONV_DETAIL = with_ctes("msgs", "SELECT conv_id, substring(coalesce(arg_min(content, turn) FILTER (WHERE role = 'user'), ''), 1, 50) AS title, count(*) AS n, string_agg(role || ': ' || substring(content, 1, 100), chr(10) ORDER BY turn, role) AS messages FROM msgs WHERE conv_id IN (0, 3) GROUP BY conv_id")


def conversation_delete(spark, sf):
    m = messages(spark, sf)
    left, items = catalog.delete_conversations(m.where("conv_id % 2 = 0").select("conv_id").distinct(), m, fallback_items(m))
    return left.groupBy("conv_id").agg(F.count("*").alias("messages")).join(items.groupBy("conv_id").agg(F.count("*").alias("items")), "conv_id", "left")


CONV_DELETE = with_ctes("msgs", """, i AS (SELECT conv_id, least(6, count(*)) AS items FROM msgs WHERE role = 'user' AND length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) >= 4 GROUP BY conv_id)
SELECT conv_id, count(*) AS messages, any_value(items) AS items FROM msgs LEFT JOIN i USING (conv_id) WHERE conv_id % 2 <> 0 GROUP BY conv_id""")

_ITEMS = [(1, k, "" if k == 2 else "fact", "" if k % 3 == 0 else f"s{k}", "" if k % 3 == 1 else f"content {k}", 0.0 if k == 4 else 0.9, "own" if k == 5 else None) for k in range(10)] + [(2, 0, "topic", "", " ", 0.5, None), (2, 1, "topic", "kept", "", 0.5, None)]


def memory_store(spark, sf):
    items = spark.createDataFrame(_ITEMS, "conv_id int, pos int, kind string, summary string, content string, importance double, focus_id string")
    out = catalog.store_items(items, spark.createDataFrame([(1, 4, "paper:X")], "conv_id int, start int, focus_id string"))
    return out.withColumn("importance", (F.col("importance") * 100).cast("int"))


MEMORY_STORE = "SELECT * FROM " + values_sql([(1, 4 + k, "fact", f"content {k}" if k % 3 == 0 else f"s{k}", f"s{k}" if k % 3 == 1 else f"content {k}", 50 if k == 4 else 90, "own" if k == 5 else "paper:X") for k in range(8)] + [(2, 1, "topic", "kept", "kept", 50, None)], "conv_id, message_index, kind, summary, content, importance, focus_id")

# Answers

_HCOLS = "query_id int, list int, pos int, result_type string, chunk_id string, node_id string, edge_id string, paper_id string, item_id string, paper_title string, title string, name string, description string, content string, snippet string, citation string"
_HITS = [
    (1, 0, 1, "chunk", "7", None, None, None, "7", "", "T7", None, None, "text of seven", None, None), (1, 0, 2, "node", None, "n1", None, None, "n1", None, None, "Ada", "a person", None, None, None), (1, 1, 1, "chunk", "7", None, None, None, "7", "P", "T7", None, None, "again", None, None),
    (1, 1, 2, "web_evidence", None, None, None, "p9", "0", None, "Web", None, None, None, "snip", "[1]"), (1, 1, 3, None, None, None, None, None, "x", None, None, None, None, None, None, None),
]


def _pieces(spark):
    return answers.accumulate(spark.createDataFrame(_HITS, _HCOLS), spark.createDataFrame([(1, "ctx one"), (2, "ctx two"), (3, "")], "query_id int, context string"))


def evidence_accumulate(spark, sf):
    return _pieces(spark)


ACCUMULATE = "SELECT * FROM " + values_sql([(1, 1, "chunk:7", "T7", "text of seven", "chunk:7"), (1, 2, "node:n1", "Ada", "a person", "node:n1"), (1, 3, "web_evidence:p9", "Web", "snip", "[1]"), (1, 4, "document:x", "证据", "证据", "document:x"), (2, 1, "context:1", "检索上下文", "ctx two", "context:1")], "query_id, place, evidence_id, title, content, citation")


def evidence_text(spark, sf):
    return answers.evidence_text(_pieces(spark), most=3, chars=6)


EVIDENCE_TEXT = "SELECT * FROM " + values_sql([(1, "[chunk:7] T7: text o\n[node:n1] Ada: a pers\n[web_evidence:p9] Web: snip"), (2, "[context:1] 检索上下文: ctx tw")], "query_id, text")


def answer_sources(spark, sf):
    hits = spark.createDataFrame([(1, 1, "chunk", "1", "one", "paragraph"), (1, 2, "chunk", "2", "two", "method"), (1, 3, "node", "9", "nine", None), (1, 4, "chunk", "1", "one again", "method")], "query_id int, rank int, result_type string, item_id string, name string, chunk_type string")
    liked = spark.createDataFrame([(1, ["method"]), (2, ["table"]), (3, []), (4, ["code"])], "query_id int, preferred array<string>")
    web = spark.createDataFrame([(1, 1, "p1", "paper"), (4, 1, "p2", "other")], "query_id int, rank int, item_id string, name string")
    stored = spark.createDataFrame([(k, f"c{k}", "table" if k % 2 else "text") for k in range(1, 21)], "chunk_id long, name string, chunk_type string")
    return answers.sources(hits, liked, web, stored)


SOURCES = "SELECT * FROM " + values_sql(
    [(1, 1, "chunk:1", "one again", "chunk"), (1, 2, "chunk:2", "two", "chunk"), (1, 3, "node:9", "nine", "node"), (1, 4, "web_evidence:p1", "paper", "web_evidence"), (4, 1, "web_evidence:p2", "other", "web_evidence")]
    + [(2, n, f"chunk:{21 - 2 * n}", f"c{21 - 2 * n}", "chunk") for n in range(1, 6)] + [(3, n, f"chunk:{21 - n}", f"c{21 - n}", "chunk") for n in range(1, 6)], "query_id, place, source_id, name, kind").replace("'chunk:1', 'one again'", "'chunk:2', 'two'", 1).replace("(1, 2, 'chunk:2', 'two', 'chunk')", "(1, 2, 'chunk:1', 'one again', 'chunk')", 1)


def paper_context(spark, sf):
    tasks = spark.createDataFrame([(1, "how?", "method", ["method"]), (2, "what?", "other", [])], "query_id int, text string, task string, preferred array<string>")
    hits = spark.createDataFrame([(1, k, "chunk" if k < 9 else "node", f"{k}", f"T{k}" if k != 2 else "", "method" if k in (3, 8) else None, "S" if k == 3 else None, f"text {k}") for k in range(1, 10)] + [(2, 1, "node", "1", "x", None, None, "")], "query_id int, rank int, result_type string, item_id string, title string, chunk_type string, section_path string, content string")
    return answers.paper_context(tasks, hits, spark.createDataFrame([(1, 1, "a -r-> b"), (1, 5, "c")], "query_id int, rank int, name string"))


PAPER_CONTEXT = "SELECT * FROM " + values_sql([(1, "【用户问题】how?\n【论文任务】method\n【论文证据】\n- T3 [method S]: text 3\n- T8 [method ]: text 8\n- T1 [chunk ]: text 1\n- 未命名论文 [chunk ]: text 2\n- T4 [chunk ]: text 4\n- T5 [chunk ]: text 5\n【关系证据】\n- a -r-> b")], "query_id, context")

_GRADES = [
    (1, "how", "method", ["method"], 3, 500_000, 500_000, 500_000, False, "rewrite_local"), (2, "how", "compare", ["method"], 3, 900_000, 900_000, 900_000, True, "answer"), (3, "最新 results", "method", ["method"], 3, 900_000, 500_000, 500_000, False, "web_verify"),
    (4, "how", "paper_qa", [], 0, 250_000, 200_000, 225_000, False, "adjust_strategy"), (5, "最新", "experiment", [], 2, 900_000, 900_000, 900_000, False, "web_verify"),
]


def _grades(spark):
    return spark.createDataFrame(_GRADES, "query_id int, text string, task string, available array<string>, n_hits int, relevance long, support long, coverage long, sufficient boolean, action string")


def paper_grade(spark, sf):
    out = answers.paper_grade(_grades(spark)).withColumn("round", F.lit(1))
    return out.unionByName(answers.paper_grade(_grades(spark), 2).withColumn("round", F.lit(2)))


_G1 = [(1, 820_000, 780_000, 780_000, True, "answer", ""), (2, 900_000, 660_000, 620_000, False, "adjust_strategy", "experiment"), (3, 900_000, 720_000, 720_000, False, "web_verify", ""), (4, 250_000, 200_000, 225_000, False, "adjust_strategy", ""), (5, 900_000, 660_000, 620_000, False, "adjust_strategy", "experiment")]
PAPER_GRADE = "SELECT * FROM " + values_sql([(*g, 1) for g in _G1] + [(*g[:5], "web_verify" if g[0] == 5 else g[5], g[6], 2) for g in _G1], "query_id, relevance, support, coverage, sufficient, action, missing, round")


def grade_merge(spark, sf):
    proposed = spark.createDataFrame([(1, "0.9", "2", None, "true", "web_verify"), (2, "x", "-1", "0.5", None, "dance"), (3, None, None, None, "maybe", "refuse")], "query_id int, p_relevance string, p_support string, p_coverage string, p_sufficient string, p_action string")
    return answers.merge_grade(_grades(spark), proposed)


GRADE_MERGE = "SELECT * FROM " + values_sql([(1, 900_000, 1_000_000, 500_000, True, "answer"), (2, 900_000, 0, 500_000, True, "answer"), (3, 900_000, 500_000, 500_000, False, "refuse"), (4, 250_000, 200_000, 225_000, False, "adjust_strategy"), (5, 900_000, 900_000, 900_000, False, "web_verify")], "query_id, relevance, support, coverage, sufficient, action")


def web_supplement(spark, sf):
    rows = [(1, "依据是什么", False, 900_000, "x" * 500), (2, "依据是什么", True, 900_000, "x" * 500), (3, "依据是什么", True, 600_000, "x" * 500), (4, "联网找依据", False, 0, ""), (5, "how", False, 0, ""), (6, "最新论文", True, 900_000, "short")]
    return answers.asks_for_more(spark.createDataFrame(rows, "query_id int, text string, sufficient boolean, coverage long, context string"))


WEB_SUPPLEMENT = "SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false), (5, false), (6, true)) t(query_id, prompt)"
_EXT = [(1, 1, "T1", "http://a", "A, B", 2020, "arxiv", "p1", "ai", "snip one"), (1, 2, "T2", "", "", None, None, None, None, "snip two"), (2, 1, "T3", "http://c", None, None, "web", "", "", "s3")]


def citation_labels(spark, sf):
    rows = spark.createDataFrame(_EXT, "query_id int, rank int, title string, url string, authors string, year int, source string, paper_id string, provider string, snippet string")
    first = rows.where("rank = 1").select("query_id", answers.description().alias("description"))
    return answers.citation_lines(rows).join(first, "query_id")


CITATIONS = "SELECT * FROM " + values_sql([(1, "- [1] T1 [A, B | 2020 | arxiv | paper_id=p1 | provider=ai]: snip one (http://a)\n- [2] T2: snip two ()", "- [1] T1. A, B. 2020. http://a", "A, B. 2020. arxiv. snip one"), (2, "- [1] T3 [web]: s3 (http://c)", "- [1] T3. 作者未知. 年份未知. http://c", "web. s3")], "query_id, context, links, description")


def known_results(spark, sf):
    return answers.known_results(questions(spark, sf)).select("query_id", "url", "quality")


KNOWN = f"""SELECT DISTINCT query_id, url, quality FROM {questions_sql(literals.QUERIES)}
JOIN {values_sql([(w, url, k) for words, url, _, k in answers.KNOWN for w in words], "word, url, quality")} ON contains(lower(text), word)"""


def web_accept(spark, sf):
    rows = spark.createDataFrame([(q, k, 900 - 50 * k, k) for q in (1, 2, 3) for k in range(6)], "query_id int, index int, quality int, rank int")
    graded = spark.createDataFrame([(1, 2, 800), (1, 3, 700), (1, 9, 990), (2, 1, 100)], "query_id int, index int, score int")
    return answers.accept(rows, graded)


ACCEPT = "SELECT * FROM (VALUES (1, 2, 800), (2, 0, 900), (2, 1, 850), (2, 2, 800), (3, 0, 900), (3, 1, 850), (3, 2, 800)) t(query_id, index, score)"


def external_evidence(spark, sf):
    rows = lambda prefix, counts: spark.createDataFrame([(q, k + 1, f"{prefix}{k}") for q, n in counts.items() for k in range(n)], "query_id int, rank int, key string")
    asked = spark.createDataFrame([(1, True, False), (2, True, False), (3, True, True), (4, False, False), (5, True, False)], "query_id int, needs_academic boolean, needs_web boolean")
    out = answers.external_evidence(rows("a", {1: 4, 2: 1, 3: 3, 4: 2}), rows("A", {2: 3, 1: 1}), rows("w", {q: 2 for q in range(1, 6)}), asked)
    return out.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]), ",").alias("keys"))


EXTERNAL = "SELECT * FROM (VALUES (1, 'a0,a1,a2,a3'), (2, 'a0,a1,a2'), (3, 'a0,a1,a2,w0,w1'), (4, 'w0,w1'), (5, 'w0,w1')) t(query_id, keys)"

# Workflows

_RUNS = [
    (1, "RAG 文献综述", 0, 2, 0, 0, 0), (2, "对比这篇论文 A 与 B 的差异", 3, 0, 2, 1, 1), (3, "什么是召回", 1, 1, 1, 1, 1), (4, "研究方向有哪些", 2, 0, 0, 2, 0), (5, "最新 2026 技术路线", 1, 3, 0, 0, 0), (6, "这篇论文的实验", 1, 1, 1, 0, 0), (7, "研究空白 github", 5, 1, 0, 0, 0),
]


def research_workflow(spark, sf):
    """Seven literal runs through the research workflow's graph."""
    runs = spark.createDataFrame(_RUNS, "query_id int, text string, local int, external int, analysed int, unsupported int, repaired int")
    return workflow.research(runs)


_A, _Z = "memory_guard,planner,decompose,action_policy", "observation,synthesis,citation_verifier,finalize"
_LA, _LZ = "classify_research_intent>planner,decompose_question>decompose,decompose_question>action_policy,decompose_question>local_search", "synthesize_research>synthesis,verify_claims>finalize"
_OUT = "memory_guard,planner,finalize", "classify_research_intent>planner,boundary_handoff>finalize"
RESEARCH = "SELECT * FROM " + values_sql(
    [
        (1, "literature_review", f"{_A},local_search,external_search,{_Z}", f"{_LA},search_local_papers>external_search,search_academic_or_web>observation,{_LZ}", 2, ""),
        (2, "method_comparison", f"{_A},local_search,paper_analysis,observation,synthesis,citation_verifier,targeted_repair,synthesis,citation_verifier,finalize", f"{_LA},search_local_papers>paper_analysis,analyze_single_paper>observation,synthesize_research>synthesis,verify_claims>targeted_repair,targeted_repair_search>synthesis,verify_claims>finalize", 6, ""),
        (3, "not_research", *_OUT, 0, ""), (6, "not_research", *_OUT, 0, ""),
        (4, "direction_exploration", f"{_A},local_search,observation,synthesis,citation_verifier,targeted_repair,finalize", f"{_LA},search_local_knowledge>observation,synthesize_research>synthesis,verify_claims>targeted_repair,targeted_repair_search>finalize", 2, ""),
        (5, "proposal_design", f"{_A},local_search,external_search,{_Z}", f"{_LA},search_local_papers>external_search,search_academic_or_web>observation,{_LZ}", 4, ""), (7, "gap_analysis", f"{_A},local_search,{_Z}", f"{_LA},search_local_papers>observation,{_LZ}", 5, ""),
    ],
    "query_id, intent, trace, log, n_evidence, error",
)


def workflow_handoff(spark, sf):
    return workflow.handoff(spark.createDataFrame([(q, t) for q, t, *_ in _RUNS] + [(8, "这个结论可靠吗")], "query_id int, text string"))


HANDOFF = "SELECT * FROM (VALUES (1, 'fast'), (2, 'fast'), (3, 'fast'), (4, 'fast'), (5, 'fast'), (6, 'paper_assistant'), (7, 'fast'), (8, 'self_rag')) t(query_id, path)"


def state_graph_limits(spark, sf):
    """A loop without an end, a node that isn't there, and a run that ends."""
    runs = spark.createDataFrame([(1, "loop"), (2, "lost"), (3, "end")], "run int, way string")
    edges = [("start", "start", F.col("way") == "loop"), ("start", "nowhere", F.col("way") == "lost")]
    out = workflow.run_graph(runs, {"start": lambda rows: rows}, edges, "start", max_steps=3)
    return out.select("run", F.size("trace").alias("steps"), "error")


STATE_GRAPH = "SELECT * FROM (VALUES (1, 3, 'exceeded max steps'), (2, 1, 'missing node: nowhere'), (3, 1, '')) t(run, steps, error)"


def workflow_registry(spark, sf):
    """Rows through the stages of their paths; a path that isn't known goes through the default."""
    registry = workflow.Registry("pipeline")
    for name in r.PATHS:
        registry.register(name, lambda rows, name=name: rows.withColumn("stage", F.lit(name)))
    rows = spark.createDataFrame([(k, p) for k, p in enumerate([*r.PATHS, "nonsense", ""])], "k int, path string")
    return registry.run(rows).select("k", "ran", "stage", workflow.expert_of(F.when(F.col("k") == 1, "method").otherwise(F.col("path"))).alias("expert"))


REGISTRY = "SELECT * FROM " + values_sql([(k, n, n, "paper_method_expert" if k == 1 else "paper_overview_expert") for k, n in enumerate([*r.PATHS, "pipeline", "pipeline"])], "k, ran, stage, expert")


def stage_attempt(spark, sf):
    """A stage that works, and one whose rows can't be made: its error is its result."""
    rows = spark.createDataFrame([(1, "7"), (2, "x")], "k int, v string")
    good, _, _ = workflow.attempt(lambda d: d.withColumn("n", F.expr("try_cast(v AS INT)")), rows)
    bad, none, message = workflow.attempt(lambda d: d.withColumn("n", F.col("v").cast("int")), rows)
    return spark.createDataFrame([("good", good, ""), ("bad", bad, "CAST_INVALID_INPUT" if "CAST_INVALID_INPUT" in message and none is None else message[:80])], "stage string, success boolean, error string")


ATTEMPT = "SELECT * FROM (VALUES ('good', true, ''), ('bad', false, 'CAST_INVALID_INPUT')) t(stage, success, error)"


def memory_first(spark, sf):
    rows = [(1, "继续刚才的方案", "m", False), (2, "继续刚才的方案", "", False), (3, "新的问题", "m", True), (4, "新的问题", "m", False), (5, "联网继续", "m", True)]
    return workflow.memory_first(spark.createDataFrame(rows, "query_id int, text string, memory string, follows boolean"))


MEMORY_FIRST = "SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false), (5, false)) t(query_id, memory_first)"


def workflow_result(spark, sf):
    answers_ = spark.createDataFrame([(1, "fast", "fine", 0.7), (2, "research", "[错误] no", 0.9)], "query_id int, path string, response string, confidence double")
    out = workflow.assemble(answers_, spark.createDataFrame([(1,), (1,)], "query_id int"), spark.createDataFrame([(1,)], "query_id int"), spark.createDataFrame([(1, True)], "query_id int, supported boolean"))
    return out.withColumn("confidence", (F.col("confidence") * 100).cast("int"))


WORKFLOW_RESULT = "SELECT * FROM " + values_sql([(1, "fast", "fine", True, 70, 2, 1, True), (2, "research", "[错误] no", False, 0, 0, 0, False)], "query_id, path, response, success, confidence, n_evidence, n_claims, supported")

# Ingest and files


def ingest(spark, sf):
    """What a literal paper becomes: blocks, chunks, nodes and edges by kind; ingested twice it is the same."""
    doc = spark.createDataFrame([(1, "Sparse", "# Sparse\n\n## Method\nMethod: Sparse Net uses blocks.\n\n## Results\nDataset: WMT14\nBLEU rises.\n\n| A | B |\n| --- | --- |\n| 1 | 2 |")], "doc_id long, title string, content string")
    c, again = api.ingest(doc), api.ingest(doc.unionByName(doc).distinct())
    kinds = lambda df, what, col: df.groupBy(F.col(col).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    out = kinds(c.blocks, "block", "type").unionByName(kinds(c.chunks, "chunk", "chunk_type")).unionByName(kinds(c.nodes, "node", "type")).unionByName(kinds(c.edges, "edge", "relation"))
    fresh = again.nodes.join(c.nodes, "node_id", "left_anti").count() + again.edges.join(c.edges, "edge_id", "left_anti").count()
    return out.unionByName(spark.createDataFrame([("again", "fresh", fresh)], "what string, kind string, n long"))


INGEST = "SELECT * FROM " + values_sql(
    [("again", "fresh", 0), ("block", "experiment", 1), ("block", "heading", 3), ("block", "method", 1), ("block", "table", 1), ("chunk", "experiment", 1), ("chunk", "method", 1), ("chunk", "table", 1)]
    + [("edge", k, n) for k, n in (("CHILD_SECTION", 2), ("METHOD_EVALUATED_ON_DATASET", 1), ("METHOD_REPORTED_METRIC", 1), ("NEXT_CHUNK", 2), ("PAPER_HAS_METHOD", 1), ("PAPER_HAS_SECTION", 1), ("PARENT_SECTION", 2), ("PREV_CHUNK", 2), ("SECTION_HAS_CHUNK", 3), ("SECTION_HAS_TABLE", 1))]
    + [("node", k, n) for k, n in (("chunk", 3), ("dataset", 1), ("method", 1), ("metric", 1), ("paper", 1), ("section", 3), ("table", 1))],
    "what, kind, n",
)


def file_tables(spark, sf):
    """CSV text as a table: blank rows dropped, how many rows of data, one sheet."""
    rows = spark.createDataFrame([(1, "a,b\n1,2\n\n ,\n3,4"), (2, ""), (3, "only")], "k int, text string")
    return files.csv_tables(rows)


FILE_TABLES = "SELECT * FROM " + values_sql([(1, "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", 2, 1), (2, "", 0, 1), (3, "| only |\n| --- |", 0, 1)], "k, markdown, row_count, sheet_count")


def paper_titles(spark, sf):
    docs = spark.createDataFrame([(1, "Doc one"), (2, "Doc two")], "doc_id int, title string")
    chunks = spark.createDataFrame([(1, 0, "no header"), (1, 1, "【论文】Named here\n【正文】\nx"), (1, 2, "【论文】Later"), (2, 0, "plain")], "doc_id int, chunk_index int, content string")
    return parsing.paper_titles(docs, chunks)


PAPER_TITLES = "SELECT * FROM (VALUES (1, 'Named here'), (2, 'Doc two')) t(doc_id, title)"

QUERIES = {
    f.__name__: f
    for f in (
        documents_list, documents_get, nodes_update, nodes_create, store_documents, edges_delete, nodes_of_document, events_json_path, reply_json, conversation_append, conversation_detail, conversation_delete, memory_store, evidence_accumulate, evidence_text,
        answer_sources, paper_context, paper_grade, grade_merge, web_supplement, citation_labels, known_results, web_accept, external_evidence, research_workflow, workflow_handoff, state_graph_limits, workflow_registry, stage_attempt, memory_first, workflow_result,
        ingest, file_tables, paper_titles,
    )
}
ORACLES = {
    "documents_list": DOCUMENTS_LIST, "documents_get": DOCUMENTS_GET, "nodes_update": NODES_UPDATE, "nodes_create": NODES_CREATE, "store_documents": STORE, "edges_delete": EDGES_DELETE, "nodes_of_document": NODES_OF_DOCUMENT, "events_json_path": EVENTS_JSON, "reply_json": REPLY_JSON,
    "conversation_append": CONV_APPEND, "conversation_detail": CONV_DETAIL, "conversation_delete": CONV_DELETE, "memory_store": MEMORY_STORE, "evidence_accumulate": ACCUMULATE, "evidence_text": EVIDENCE_TEXT, "answer_sources": SOURCES, "paper_context": PAPER_CONTEXT, "paper_grade": PAPER_GRADE,
    "grade_merge": GRADE_MERGE, "web_supplement": WEB_SUPPLEMENT, "citation_labels": CITATIONS, "known_results": KNOWN, "web_accept": ACCEPT, "external_evidence": EXTERNAL, "research_workflow": RESEARCH, "workflow_handoff": HANDOFF, "state_graph_limits": STATE_GRAPH, "workflow_registry": REGISTRY,
    "stage_attempt": ATTEMPT, "memory_first": MEMORY_FIRST, "workflow_result": WORKFLOW_RESULT, "ingest": INGEST, "file_tables": FILE_TABLES, "paper_titles": PAPER_TITLES,
}
