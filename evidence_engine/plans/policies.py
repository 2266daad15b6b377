"""Queries of gates, policies and page layout with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_engine.operators import layout, parsing, segments
from evidence_engine.operators import policies as po
from evidence_engine.operators import routing as r
from evidence_engine.plans.routing import _FIELDS, _RULE, RESEARCH, has
from evidence_engine.sources import literals
from evidence_engine.sources.literals import values_sql
from evidence_engine.sources.tables import graph_nodes, questions, questions_sql, read, with_ctes

_Q = questions_sql(literals.QUERIES)
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_PLANNED = f"SELECT x.query_id, x.text, x.q, {_FIELDS} FROM (SELECT *, {_RULE} AS rule FROM (SELECT query_id, text, {_STRIP.format('text')} AS q FROM {_Q})) x JOIN {values_sql([(k, *v) for k, v in r.PLANS.items()], 'rule, ' + ', '.join(r.PLAN_FIELDS))} p USING (rule)"


def model_gate(spark, sf):
    return po.model_gate(r.rule_plan(questions(spark, sf)))


MODEL_GATE = f"""SELECT query_id, CASE WHEN intent = 'chat' THEN false WHEN length(q) <= 12 AND intent IN ('fact', 'exact') THEN false
  WHEN {has('q', po.AMBIGUOUS)} OR length(q) >= 25 OR CAST({has('q', r.GLOBAL)} AS INT) + CAST({has('q', r.RELATION)} AS INT) + CAST({has('q', r.SEMANTIC)} AS INT) >= 2 OR confidence < 0.65 THEN true ELSE graph_method IN ('path', 'subgraph') END AS ask FROM ({_PLANNED})"""

_OVER = [(4, "99", "x", None, "0", "path", " explain ", ["table", " ", "method"]), (9, "3", "7", "5", None, "bogus", "", []), (10, None, None, None, None, None, None, None)]
_OCOLS = "query_id, o_bm25_top_k, o_vector_top_k, o_graph_top_k, o_graph_depth, o_graph_method, o_intent, o_preferred"


def plan_override(spark, sf):
    over = spark.createDataFrame(_OVER, "query_id int, o_bm25_top_k string, o_vector_top_k string, o_graph_top_k string, o_graph_depth string, o_graph_method string, o_intent string, o_preferred array<string>")
    return po.override_plan(r.rule_plan(questions(spark, sf)), over)


PLAN_OVERRIDE = f"""SELECT p.query_id, {', '.join('CASE WHEN try_cast(o_%s AS INTEGER) IS NULL THEN %s ELSE CAST(greatest(1, least(20, try_cast(o_%s AS INTEGER))) AS INTEGER) END AS %s' % (c, c, c, c) for c in ('bm25_top_k', 'vector_top_k', 'graph_top_k', 'graph_depth'))},
  CASE WHEN o_graph_method IN ('none', 'ego', 'path', 'subgraph') THEN o_graph_method ELSE graph_method END AS graph_method, coalesce(nullif({_STRIP.format('o_intent')}, ''), intent) AS intent, coalesce(array_to_string(list_filter(o_preferred, lambda x: {_STRIP.format('x')} <> '')[1:8], ','), '') AS preferred
FROM ({_PLANNED}) p LEFT JOIN {values_sql(_OVER, _OCOLS)} USING (query_id)"""


def search_mode(spark, sf):
    q = questions(spark, sf).unionByName(literals.academic(spark).select((F.col("query_id") + 100).alias("query_id"), "text"))
    return q.select("query_id", po.search_mode(F.col("text")).alias("mode"), po.needs_verification(F.col("text")).alias("verify"))


_BOTH = f"(SELECT * FROM {_Q} UNION ALL SELECT query_id + 100, text FROM {values_sql(literals.ACADEMIC, 'query_id, text')})"
SEARCH_MODE = f"""SELECT query_id, CASE WHEN p AND w THEN 'mixed' WHEN p THEN 'academic' ELSE 'web' END AS mode, {has('low', po.VERIFY_TERMS)} AND {has('low', po.METHOD_TERMS)} AS verify
FROM (SELECT *, {has('low', po.PAPER_MODE)} AS p, {has('low', po.WEB_MODE)} AS w FROM (SELECT query_id, lower(text) AS low FROM {_BOTH}))"""


def contextual_query(spark, sf):
    return po.contextual_query(questions(spark, sf), literals.turns(spark))


_FUP = f"(CASE WHEN {{0}} = '' THEN false WHEN {has('{0}', po.FOLLOW_LONG)} THEN length({{0}}) <= 24 ELSE length({{0}}) <= 12 AND {has('{0}', po.FOLLOW_SHORT)} END)"
CONTEXTUAL = f"""WITH t AS (SELECT query_id, arg_max(c, pos) AS topic FROM (SELECT query_id, pos, role, {_STRIP.format('content')} AS c FROM {values_sql(literals.TURNS, 'query_id, pos, role, content, path, intent')}) WHERE role = 'user' AND c <> '' AND NOT {_FUP.replace('{0}', 'c')} GROUP BY query_id)
SELECT q.query_id, CASE WHEN {_FUP.replace('{0}', 'q.s')} AND topic IS NOT NULL THEN topic || chr(10) || q.text ELSE q.text END AS query FROM (SELECT *, {_STRIP.format('text')} AS s FROM {_Q}) q LEFT JOIN t USING (query_id)"""


def planned_actions(spark, sf):
    q = questions(spark, sf)
    return po.planned_actions(q.join(r.research_intent(q), "query_id")).withColumn("actions", F.array_join("actions", ">"))


ACTIONS = f"""SELECT query_id, concat_ws('>', CASE WHEN intent IN {po.LOCAL_PAPERS} THEN 'search_local_papers' WHEN intent = 'direction_exploration' THEN 'search_local_knowledge' END, CASE WHEN {has('lower(text)', r.WEB)} OR {has('text', po.FRESH)} THEN 'search_academic_or_web' END,
  CASE WHEN intent = 'method_comparison' AND {has('lower(text)', po.ONE_PAPER)} THEN 'analyze_single_paper' END, 'synthesize_research', 'verify_claims', 'final_answer') AS actions FROM {_Q} JOIN ({RESEARCH}) USING (query_id)"""

_STATES = [(1, ["search_academic_or_web"], "x", 5, False), (2, ["analyze_single_paper"], "literature_review", 0, False), (3, ["analyze_single_paper"], "method_comparison", 0, True), (4, [], "gap_analysis", 2, True), (5, [], "gap_analysis", 3, True), (6, [], "x", 0, True)]

_STEPS_OF = ("search_academic_or_web", "analyze_single_paper", "synthesize_research")
_INTENTS_OF = ("literature_review", "gap_analysis", "proposal_design", "method_comparison", "x")
_MADE = f"""(SELECT * FROM {values_sql(_STATES, 'query_id, actions, intent, n_evidence, fresh')} UNION ALL
  SELECT doc_id + 100, [CAST({list(_STEPS_OF)} AS VARCHAR[])[1 + doc_id * 5 % {len(_STEPS_OF)}]], CAST({list(_INTENTS_OF)} AS VARCHAR[])[1 + doc_id * 3 % {len(_INTENTS_OF)}], doc_id % 6, toxic = 1 FROM labels)"""


def next_step(spark, sf):
    """The literal states, and one of every labelled document."""
    doc = F.col("doc_id")
    pick = lambda words, k: F.element_at(F.array(*(F.lit(w) for w in words)), (F.lit(1) + (doc * k) % len(words)).cast("int"))
    made = read(spark, sf, "labels").select((doc + 100).alias("query_id"), F.array(pick(_STEPS_OF, 5)).alias("actions"), pick(_INTENTS_OF, 3).alias("intent"), (doc % 6).alias("n_evidence"), (F.col("toxic") == 1).alias("fresh"))
    return po.next_step(spark.createDataFrame(_STATES, "query_id long, actions array<string>, intent string, n_evidence long, fresh boolean").unionByName(made))


NEXT_STEP = f"""SELECT query_id, CASE WHEN list_contains(actions, 'search_academic_or_web') OR intent IN ('literature_review', 'gap_analysis', 'proposal_design') AND (n_evidence = 0 OR fresh AND n_evidence < 3) THEN 'external_search' WHEN list_contains(actions, 'analyze_single_paper') THEN 'paper_analysis' ELSE 'observation' END AS next
FROM {_MADE}"""


def fallback_plan(spark, sf):
    return po.fallback_plan(read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")))


FALLBACK = f"SELECT item_id AS query_id, CAST(k AS INTEGER) AS pos, 't' || k AS id, type, CASE WHEN k = 1 THEN '' ELSE 't' || (k - 1) END AS depends_on FROM benchmark, {values_sql([(k + 1, t) for k, t in enumerate(po.FALLBACK_TASKS)], 'k, type')}"

_ANSWERS = [(1, "yes", "ctx", 0), (2, "yes", " ", 0), (3, " ", "ctx", 2), (4, "yes", "", 1)]

_SAID = f"""(SELECT * FROM {values_sql(_ANSWERS, 'query_id, answer, context, n_web')} UNION ALL
  SELECT a.conv_id * 1000 + a.turn + 100, a.text, coalesce(b.text, ''), a.turn % 3 FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant')"""


def answer_verify(spark, sf):
    """The literal answers, and every assistant's turn with the turn before it as context."""
    m = read(spark, sf, "conversations")
    before = m.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    said = m.where("role = 'assistant'").join(before, ["conv_id", "turn"], "left").select((F.col("conv_id") * 1000 + F.col("turn") + 100).alias("query_id"), F.col("text").alias("answer"), F.coalesce("context", F.lit("")).alias("context"), (F.col("turn") % 3).alias("n_web"))
    return po.verify_answer(spark.createDataFrame(_ANSWERS, "query_id long, answer string, context string, n_web long").unionByName(said))


ANSWER_VERIFY = f"SELECT query_id, ok AS supported, CASE WHEN ok THEN 'answer' ELSE 'refuse' END AS action FROM (SELECT *, {_STRIP.format('answer')} <> '' AND ({_STRIP.format('context')} <> '' OR n_web > 0) AS ok FROM {_SAID})"

_LISTS = "SELECT conv_id AS query_id, turn % 3 AS list, turn AS pos, role || (turn % 4) AS evidence_id, CASE WHEN turn % 2 = 0 THEN 'table' ELSE 'paragraph' END AS chunk_type FROM conversations"


def evidence_merge(spark, sf):
    m = read(spark, sf, "conversations")
    lists = m.select(F.col("conv_id").alias("query_id"), (F.col("turn") % 3).alias("list"), F.col("turn").alias("pos"), F.concat("role", (F.col("turn") % 4).cast("string")).alias("evidence_id"), F.when(F.col("turn") % 2 == 0, "table").otherwise("paragraph").alias("chunk_type"))
    return po.merge_evidence(lists, 5, F.array(F.lit("table")))


MERGE = f"""WITH f AS (SELECT *, CASE WHEN chunk_type = 'table' THEN 0 ELSE 1 END AS liked, row_number() OVER (PARTITION BY query_id, evidence_id ORDER BY list, pos) AS k FROM ({_LISTS}))
SELECT query_id, CAST(place AS INTEGER) AS place, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY liked, list, pos) AS place FROM f WHERE k = 1) WHERE place <= 5"""

_ORIGINAL, _GROUPS, _SEARCH = [(1, "p1"), (2, "p2")], [(1, "references", "p3"), (1, "citations", "p4")], [(1, "s1"), (2, "s2"), (2, "s3")]


def related_papers(spark, sf):
    """Beside the literal ones, each supplier as a paper: it cites what it shipped of the first parts, and a search finds it."""
    sup, line = read(spark, sf, "supplier"), read(spark, sf, "lineitem")
    name = lambda c: F.concat(F.lit("s"), F.col(c))
    original = spark.createDataFrame(_ORIGINAL, "query_id long, paper_id string").unionByName(sup.select((F.col("s_suppkey") + 100).alias("query_id"), name("s_suppkey").alias("paper_id")))
    cited = line.where("l_partkey <= 5").select((F.col("l_suppkey") + 100).alias("query_id"), F.lit("references").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("paper_id")).distinct()
    groups = spark.createDataFrame(_GROUPS, "query_id long, source string, paper_id string").unionByName(cited)
    found = spark.createDataFrame(_SEARCH, "query_id long, paper_id string").unionByName(sup.select((F.col("s_suppkey") + 100).alias("query_id"), F.concat(F.lit("n"), "s_nationkey").alias("paper_id")))
    return po.related_papers(original, groups, found)


RELATED = f"""WITH o AS (SELECT * FROM {values_sql(_ORIGINAL, 'query_id, paper_id')} UNION ALL SELECT s_suppkey + 100, 's' || s_suppkey FROM supplier),
g AS (SELECT * FROM {values_sql(_GROUPS, 'query_id, source, paper_id')} UNION ALL SELECT DISTINCT l_suppkey + 100, 'references', 'p' || l_partkey FROM lineitem WHERE l_partkey <= 5),
f AS (SELECT * FROM {values_sql(_SEARCH, 'query_id, paper_id')} UNION ALL SELECT s_suppkey + 100, 'n' || s_nationkey FROM supplier)
SELECT query_id, 'original' AS source, paper_id FROM o UNION ALL SELECT * FROM g UNION ALL SELECT query_id, 'search', paper_id FROM f WHERE query_id NOT IN (SELECT query_id FROM g)"""

_IDS = [(1, "2101.1", "10.1/x", "", ""), (2, "", "10.1/x", "7", "p"), (3, None, "", "7", "p"), (4, "", "", "", "p"), (5, "", "", "", "")]


def paper_url(spark, sf):
    """The literal ids, and those of each part, which has some of the four."""
    k = F.col("p_partkey")
    some = lambda n, head: F.when(k % n == 0, F.concat(F.lit(head), k.cast("string"))).when(k % n == 1, "")
    made = read(spark, sf, "part").select((k + 100).alias("id"), some(2, "2101.").alias("arxiv_id"), some(3, "10.1/").alias("doi"), some(5, "a").alias("author_id"), some(7, "p").alias("paper_id"))
    rows = spark.createDataFrame(_IDS, "id long, arxiv_id string, doi string, author_id string, paper_id string").unionByName(made)
    return rows.select("id", po.paper_url().alias("url"))


_PARTS = f"""(SELECT * FROM {values_sql(_IDS, 'id, arxiv_id, doi, author_id, paper_id')} UNION ALL SELECT p_partkey + 100, CASE WHEN p_partkey % 2 = 0 THEN '2101.' || p_partkey WHEN p_partkey % 2 = 1 THEN '' END, CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || p_partkey WHEN p_partkey % 3 = 1 THEN '' END, CASE WHEN p_partkey % 5 = 0 THEN 'a' || p_partkey WHEN p_partkey % 5 = 1 THEN '' END, CASE WHEN p_partkey % 7 = 0 THEN 'p' || p_partkey WHEN p_partkey % 7 = 1 THEN '' END FROM part)"""
PAPER_URL = f"SELECT id, CASE WHEN arxiv_id <> '' THEN 'https://arxiv.org/abs/' || arxiv_id WHEN doi <> '' THEN 'https://doi.org/' || doi WHEN author_id <> '' THEN 'https://www.semanticscholar.org/author/' || author_id WHEN paper_id <> '' THEN 'https://www.semanticscholar.org/paper/' || paper_id ELSE '' END AS url FROM {_PARTS}"


def paper_graph_filters(spark, sf):
    return questions(spark, sf).select("query_id", F.array_join(po.relation_filter(F.col("text")), ",").alias("relations"), F.array_join(po.target_types(F.col("text")), ",").alias("targets"))


_REL = ", ".join(f"CASE WHEN {has('text', w)} THEN CAST({list(rel)} AS VARCHAR[]) ELSE CAST([] AS VARCHAR[]) END" for w, rel in po.RELATIONS)
GRAPH_FILTERS = f"""WITH x AS (SELECT query_id, flatten([{_REL}]) AS rs, concat_ws(',', {', '.join(f"CASE WHEN {has('text', w)} THEN '{k}' END" for w, k in po.TARGETS)}) AS targets FROM {_Q}),
u AS (SELECT query_id, rel, min(i) AS i FROM (SELECT query_id, unnest(rs) AS rel, generate_subscripts(rs, 1) AS i FROM x) GROUP BY ALL), g AS (SELECT query_id, string_agg(rel, ',' ORDER BY i) AS relations FROM u GROUP BY query_id)
SELECT x.query_id, coalesce(relations, '') AS relations, targets FROM x LEFT JOIN g USING (query_id)"""

_NAMES = [(1, ["widget", "ring"]), (2, ["NATION_1", "a"]), (3, ["nothing here"]), (4, [])]


def graph_seeds(spark, sf):
    nodes = graph_nodes(spark, sf).withColumn("confidence", F.lit(0.5) + (F.col("node_id") % 10) / 100)
    return po.resolve_seeds(spark.createDataFrame(_NAMES, "query_id int, names array<string>"), nodes)


SEEDS = with_ctes("g_nodes", f""", a AS (SELECT query_id, unnest(names) AS name, generate_subscripts(names, 1) AS k FROM {values_sql(_NAMES, 'query_id, names')}),
m AS (SELECT query_id, k, node_id, row_number() OVER (PARTITION BY query_id, k ORDER BY node_id % 10 DESC, node_id) AS n FROM a JOIN g_nodes g ON g.name ILIKE '%' || a.name || '%'),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY k, n) AS f FROM m WHERE n <= 5)
SELECT query_id, CAST(place AS INTEGER) AS place, node_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k, n) AS place FROM o WHERE f = 1) WHERE place <= 8""")


# Layout


def merge_lines(spark, sf):
    return segments.merged_lines(read(spark, sf, "documents")).select("doc_id", "text", F.length("text").alias("n"), F.size(F.split("text", "\n")).alias("lines"))


# A fold: one line of every document a step, with the paragraph so far.
MERGED = rf"""WITH RECURSIVE l AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[\t ]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), chr(10)) AS ls FROM documents),
f AS (
  SELECT doc_id, ls, 0 AS i, '' AS done, '' AS buf FROM l
  UNION ALL
  SELECT doc_id, ls, i + 1,
    CASE WHEN b = '' THEN done || buf || CASE WHEN buf = '' THEN '' ELSE chr(10) END || chr(10) WHEN buf = '' OR NOT apart THEN done ELSE done || buf || chr(10) END,
    CASE WHEN b = '' OR buf = '' OR apart THEN b ELSE buf || ' ' || b END
  FROM (
    SELECT *, regexp_matches(buf, '{segments.SENTENCE_END}') OR regexp_matches(b, '{segments.LIST_OR_HEADING}') OR regexp_matches(b, '{segments.CHAPTER}')
      OR regexp_matches(buf, '^[|].*[|]$') OR regexp_matches(b, '^[|].*[|]$') OR (length(buf) < {segments.TITLE_CHARS} AND regexp_matches(buf, '{segments.TITLE}')) AS apart
    FROM (SELECT *, regexp_replace(ls[i + 1], '^\s+|\s+$', '', 'g') AS b FROM f WHERE i < len(ls))))
SELECT doc_id, text, length(text) AS n, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines
FROM (SELECT doc_id, regexp_replace(done || buf, '^\s+|\s+$', '', 'g') AS text FROM f WHERE i = len(ls))"""


def plain_paragraphs(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return layout.paragraphs(docs)


_NOT, _HEADS, _NUM = layout.NOT_HEADS, layout.HEADS, layout.NUMBERED
_HEADING = f"""(t <> '' AND length(t) <= 90 AND NOT regexp_matches(t, '{_NOT}') AND (regexp_matches(t, '{_NUM}') AND length(regexp_replace(t, '{_NUM}', '')) BETWEEN 2 AND 60 AND NOT regexp_matches(regexp_replace(t, '{_NUM}', ''), '[=+∑≤≥]|[，,）。)]$')
  OR regexp_matches(t, '{_HEADS}') OR upper(t) = t AND lower(t) <> t AND length(t) BETWEEN 4 AND 70 AND contains(t, ' ')))"""
PARAGRAPHS = f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\\n', chr(10) || chr(10), 'g'), '\\n[ \\t]*\\n'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS ps FROM documents),
u AS (SELECT doc_id, unnest(ps) AS t, generate_subscripts(ps, 1) - 1 AS pos FROM p),
h AS (SELECT *, CASE WHEN NOT contains(t, chr(10)) AND {_HEADING} THEN t END AS head FROM u),
s AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), '') AS section FROM h)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, t AS text, section FROM s WHERE head IS NULL"""

LINES = [
    (1, p, 10 * p + k, t, s, b, c)
    for p, word in ((1, "scope"), (2, "design"), (3, "limits"))
    for k, (t, s, b, c) in enumerate([
        (f"Journal of Retrieval {p}", 8.0, False, True), (f"{p} Notes on {word}", 14.0, True, False), (f"Body text about {word} that runs on for a while", 10.0, False, False),
        (f"more of it on {word}, with a comma", 10.0, False, False), (f"- {p} -", 8.0, False, True), (f"RELATED {word.upper()}" if p < 3 else "RELATED DESIGN", 12.0, True, True),
    ])
] + [(2, 1, 1, "", 9.0, False, False), (2, 1, 2, "doi 10.1/x", 9.0, False, False), (2, 1, 3, "摘要", 12.0, True, True)]


def layout_text(spark, sf):
    return layout.layout_lines(spark.createDataFrame(LINES, "doc_id long, page int, line long, text string, size double, bold boolean, centered boolean"))


def chunk_headers(spark, sf):
    """Chunks of the literal papers as self-describing text, read back by the header parser."""
    from evidence_engine.plans.documents import type_aware_chunks

    rows = type_aware_chunks(spark, sf).withColumns({c: F.lit(v) for c, v in (("paper_title", "T"), ("authors", "A"), ("year", "2020"), ("method_name", "M"), ("dataset", "D"), ("metric", "F1"))})
    made = rows.select("doc_id", "chunk_index", layout.chunk_header().alias("content"))
    return made.select("doc_id", "chunk_index", *parsing.header_fields(F.col("content"), {"chunk_type": "类型", "paper_title": "论文", "method_name": "方法", "metric": "指标"}))


QUERIES = {f.__name__: f for f in (model_gate, plan_override, search_mode, contextual_query, planned_actions, next_step, fallback_plan, answer_verify, evidence_merge, related_papers, paper_url, paper_graph_filters, graph_seeds, merge_lines, plain_paragraphs, layout_text, chunk_headers)}
ORACLES = {
    "merge_lines": MERGED,
    "model_gate": MODEL_GATE, "plan_override": PLAN_OVERRIDE, "search_mode": SEARCH_MODE, "contextual_query": CONTEXTUAL, "planned_actions": ACTIONS, "next_step": NEXT_STEP, "fallback_plan": FALLBACK, "answer_verify": ANSWER_VERIFY,
    "evidence_merge": MERGE, "related_papers": RELATED, "paper_url": PAPER_URL, "paper_graph_filters": GRAPH_FILTERS, "graph_seeds": SEEDS, "plain_paragraphs": PARAGRAPHS,
}
