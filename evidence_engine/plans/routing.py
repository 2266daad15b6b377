"""Router and planner queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import functions as F

from evidence_engine.operators import routing as r
from evidence_engine.sources import literals
from evidence_engine.sources.literals import values_sql
from evidence_engine.sources.tables import academic_questions, questions, questions_sql, read


def has(col: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def count(col: str, words: Iterable[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, '{w}') AS INTEGER)" for w in words) + ")"


def _case(col: str, rules: Iterable[tuple[str, tuple[str, ...]]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(col, w)} THEN '{n}'" for n, w in rules) + f" ELSE {otherwise} END"


_RULE = f"""CASE WHEN length(q) <= 2 THEN 'short' WHEN {has('lower(q)', r.CASUAL)} AND length(q) <= 15 THEN 'casual'
  WHEN {has('q', r.GLOBAL)} THEN CASE WHEN {has('q', r.LOCAL)} THEN 'global_local' ELSE 'global' END
  WHEN {has('q', r.STRUCTURE)} THEN 'structure'
  WHEN {has('q', r.RELATION)} THEN CASE WHEN {has('q', r.RELATION_LOCAL)} THEN 'relation_local' ELSE 'relation' END
  WHEN regexp_matches(q, '{r.EXACT}') THEN 'exact'
  WHEN {has('q', r.SEMANTIC)} THEN CASE WHEN {has('q', r.OPTIMIZE)} THEN 'optimize' ELSE 'explain' END || CASE WHEN {has('q', r.SEMANTIC_GRAPH)} THEN '_graph' ELSE '' END
  ELSE 'default' END"""
_FIELDS = ", ".join(f"p.{f}" for f in r.PLAN_FIELDS)


def _plan_sql(source: str) -> str:
    plans = values_sql([(k, *v) for k, v in r.PLANS.items()], "rule, " + ", ".join(r.PLAN_FIELDS))
    return f"SELECT x.query_id, x.text, x.rule, {_FIELDS} FROM (SELECT *, {_RULE} AS rule FROM (SELECT query_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS q FROM {source})) x JOIN {plans} p USING (rule)"


#: The plans of qset, as a further common table expression.
RULE_PLAN_SQL = f",\nplans AS ({_plan_sql('qset')})"


def rule_router(spark, sf):
    out = r.rule_plan(questions(spark, sf))
    return out.select("query_id", "rule", "intent", "graph_method", "bm25_top_k", "vector_top_k", "graph_top_k", "graph_depth", F.round(F.col("confidence") * 100).cast("int").alias("confidence"), F.array_join("entities", ",").alias("entities"))


_Q = questions_sql(literals.QUERIES)
RULE_ROUTER = f"""WITH p AS ({_plan_sql(_Q)}),
e AS (SELECT query_id, term, min(i) AS i FROM (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS i FROM (SELECT query_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}|[一-龥]{{2,6}}') AS ts FROM p WHERE rule = 'exact')) GROUP BY query_id, term),
g AS (SELECT query_id, string_agg(term, ',' ORDER BY i) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS k FROM e) WHERE k <= 8 GROUP BY query_id)
SELECT p.query_id, rule, intent, graph_method, bm25_top_k, vector_top_k, graph_top_k, graph_depth, CAST(round(confidence * 100) AS INTEGER) AS confidence, coalesce(entities, '') AS entities FROM p LEFT JOIN g USING (query_id)"""

_PROPOSED = [(4, "path", "5", 0.9), (7, "nonsense", "x", 0.8), (9, "none", "2", 0.3), (10, "subgraph", None, 0.5)]


def plan_merge(spark, sf):
    proposed = spark.createDataFrame(_PROPOSED, "query_id int, p_graph_method string, p_graph_depth string, p_confidence double")
    out = r.merge_plan(r.rule_plan(questions(spark, sf)).join(proposed, "query_id", "left"))
    return out.withColumn("confidence", F.round(F.col("confidence") * 100).cast("int"))


PLAN_MERGE = f"""WITH p AS ({_plan_sql(_Q)}), x AS (SELECT p.*, coalesce(p_confidence, 0) >= 0.45 AS trust, p_graph_method, p_graph_depth, p_confidence FROM p LEFT JOIN {values_sql(_PROPOSED, 'query_id, p_graph_method, p_graph_depth, p_confidence')} USING (query_id)),
y AS (SELECT query_id, CASE WHEN trust AND p_graph_method IN ('none', 'ego', 'path', 'subgraph') THEN p_graph_method ELSE graph_method END AS m, CASE WHEN trust THEN coalesce(try_cast(p_graph_depth AS INTEGER), graph_depth) ELSE graph_depth END AS d, CASE WHEN trust THEN p_confidence ELSE confidence END AS c FROM x)
SELECT query_id, m AS graph_method, m <> 'none' AS graph, CAST(greatest(CASE WHEN m = 'path' THEN 2 ELSE 1 END, least(d, 3)) AS INTEGER) AS graph_depth, CAST(round(c * 100) AS INTEGER) AS confidence FROM y"""


def _asked(spark, sf):
    q = questions(spark, sf)
    return q.join(r.last_route(literals.turns(spark)), "query_id", "left").join(literals.forced(spark), "query_id", "left")


def context_router(spark, sf):
    return r.context_route(_asked(spark, sf))


def router_scores(spark, sf):
    return r.path_scores(r.features(questions(spark, sf))).select("query_id", *(f"s_{p}" for p in r.PATHS))


_NORMAL = "CASE WHEN {0} IN ('fast', 'pipeline', 'paper_assistant', 'self_rag', 'research') THEN {0} " + " ".join(f"WHEN {{0}} = '{a}' THEN '{b}'" for a, b in r.ALIASES.items()) + " END"
_SCORES = f"""feat AS (SELECT *, length(text) AS n, lower(text) AS low, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS q, {has('lower(text)', r.OUTLINE)} AS outline, {has('lower(text)', r.OPENING)} AS opening, {has('lower(text)', r.COMPARE)} AS cmp,
    {has('lower(text)', r.VERIFY)} AS ver, {has('lower(text)', r.FRESH)} AS fresh, {has('lower(text)', r.WEB)} AS web, {has('lower(text)', r.PAPER)} AS pap, {has('lower(text)', r.COMPLEX)} AS cpx, {has('lower(text)', r.SIMPLE)} AS simple, {has('lower(text)', r.CURRENT)} AS cur,
    len(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{{2,}}')) >= 2 OR {has('text', r.SEPARATORS)} AS multi FROM asked),
f2 AS (SELECT *, {has('low', r.RESEARCH)} AND NOT (outline OR opening) AS res, {has('low', r.DESIGN)} AND NOT (outline OR opening) AS des, cmp AND multi AND {has('low', r.SYSTEMS)} AS sys, opening AND (contains(text, '多篇论文') OR contains(text, '研究空白') OR multi) AS many FROM feat),
sc AS (SELECT *, 25 + 55 * cpx::INT + 20 * cmp::INT + 20 * multi::INT - 20 * sys::INT AS s_pipeline,
    65 * pap::INT + 35 * (pap AND NOT (des OR res OR multi OR ver))::INT + CASE WHEN opening THEN 75 WHEN outline THEN 55 ELSE 0 END - 55 * many::INT - 30 * (ver AND NOT (des OR res))::INT AS s_paper_assistant,
    75 * ver::INT + 65 * cur::INT + 45 * (fresh AND NOT web)::INT - 35 * (des OR res)::INT AS s_self_rag,
    125 * many::INT + 85 * res::INT + 65 * des::INT + 75 * (cmp AND multi)::INT + 35 * sys::INT + 35 * (pap AND (res OR multi))::INT + 35 * (ver AND des)::INT + 25 * (n > 45 AND (cpx OR des))::INT AS s_research,
    least(20 + CASE WHEN n < 30 AND simple THEN 100 WHEN n < 30 THEN 45 ELSE 0 END, CASE WHEN pap THEN 45 ELSE 1000 END) AS fast0 FROM f2),
scored AS (SELECT *, CASE WHEN s_research >= 90 THEN least(fast0, 25) ELSE fast0 END AS s_fast FROM sc)"""
_ASKED_SQL = f"""lr AS (SELECT query_id, arg_max(path, pos) AS last_path, arg_max(coalesce(intent, 'followup'), pos) AS last_intent FROM {values_sql(literals.TURNS, 'query_id, pos, role, content, path, intent')} WHERE role = 'assistant' AND path IS NOT NULL AND path <> '' GROUP BY query_id),
asked AS (SELECT query_id, text, last_path, last_intent, force_path FROM {_Q} LEFT JOIN lr USING (query_id) LEFT JOIN {values_sql(list(literals.FORCED.items()), 'query_id, force_path')} USING (query_id))"""
ROUTER_SCORES = f"WITH {_ASKED_SQL}, {_SCORES} SELECT query_id, " + ", ".join(f"CAST(s_{p} AS INTEGER) AS s_{p}" for p in r.PATHS) + " FROM scored"
_BEST = "CASE greatest(s_fast, s_pipeline, s_paper_assistant, s_self_rag, s_research) " + " ".join(f"WHEN s_{p} THEN '{p}'" for p in r.PATHS) + " END"
CONTEXT_ROUTER = f"""WITH {_ASKED_SQL}, {_SCORES},
d AS (SELECT *, {_NORMAL.format('force_path')} AS forced, {_NORMAL.format('last_path')} AS last, q <> '' AND ({has('q', r.FOLLOW_WEB)} OR CASE WHEN length(q) <= 12 THEN regexp_matches(q, '{r.FOLLOW_SHORT}') ELSE regexp_matches(q, '{r.FOLLOW_LONG}') END) AS fup, {_case('low', r.PAPER_INTENTS, "'paper_overview'")} AS pint FROM scored),
e AS (SELECT *, forced IS NULL AND fup AND last IS NOT NULL AS follows FROM d),
f AS (SELECT *, coalesce(forced, CASE WHEN follows THEN last END, {_BEST}) AS path FROM e)
SELECT query_id, path, CASE WHEN forced IS NOT NULL THEN 'force_' || forced
  WHEN follows THEN CASE WHEN last = 'paper_assistant' THEN pint WHEN last = 'self_rag' AND ver THEN 'verify_or_freshness' ELSE coalesce(nullif(last_intent, ''), 'followup') END
  WHEN path = 'research' THEN CASE WHEN des THEN 'research_design' ELSE 'research_planning' END WHEN path = 'self_rag' THEN 'verify_or_freshness' WHEN path = 'paper_assistant' THEN pint WHEN path = 'pipeline' THEN 'complex_analysis'
  WHEN simple OR n < 30 THEN 'fact_qa' ELSE 'general_qa' END AS intent, follows AS context_dependent,
  CASE WHEN path = 'fast' THEN 'minimal' WHEN path IN ('self_rag', 'research') THEN 'verbose' ELSE 'normal' END AS level FROM f"""


def paper_task_router(spark, sf):
    return r.paper_task(questions(spark, sf))


_T = ", ".join(f"{count('low', w)} AS n_{t}" for t, w in r.TASK_WORDS.items())
_TOPS = "greatest(" + ", ".join(f"n_{t}" for t in r.TASK_WORDS) + ")"
PAPER_TASK = f"""WITH s AS (SELECT query_id, low, {_T} FROM (SELECT query_id, lower(text) AS low FROM {_Q})),
t AS (SELECT query_id, CASE WHEN {_TOPS} <= 0 THEN CASE WHEN {has('low', r.PAPER_HINTS)} THEN 'overview' ELSE 'paper_qa' END
  {' '.join(f"WHEN n_{n} > 0 AND {has('low', w)} THEN '{n}'" for n, w in r.TASK_DECIDERS)} {' '.join(f"WHEN n_{t} = {_TOPS} THEN '{t}'" for t in r.TASK_WORDS)} END AS task FROM s)
SELECT query_id, task, CASE task {' '.join(f"WHEN '{t}' THEN '{','.join(k)}'" for t, k in r.PREFERRED.items())} ELSE '' END AS preferred FROM t"""


def academic_router(spark, sf):
    return r.academic_route(academic_questions(spark, sf))


_A = questions_sql(literals.ACADEMIC)
_PID = "CASE " + " ".join(f"WHEN regexp_extract(text, '{p}', 1) <> '' THEN '{x}' || regexp_extract(text, '{p}', 1)" for x, p in r.PAPER_IDS) + " ELSE '' END"
_SINCE = "coalesce(nullif(regexp_extract(lower(text), '(20[0-9]{2})[ \\t]*年?[ \\t]*(以后|以来|之后|及以后|至今|以降|后|after|since)', 1), ''), nullif(regexp_extract(lower(text), '(after|since)[ \\t]+(20[0-9]{2})', 2), ''))"
_SPAN = "'(20[0-9]{2})[ \\t]*[-—~至到][ \\t]*(20[0-9]{2})'"
_YEAR = f"CASE WHEN {_SINCE} IS NOT NULL THEN {_SINCE} || '-2026' WHEN regexp_extract(lower(text), {_SPAN}, 1) <> '' THEN regexp_extract(lower(text), {_SPAN}, 1) || '-' || regexp_extract(lower(text), {_SPAN}, 2) END"
_REST = f"CASE WHEN pid <> '' OR {has('lower(text)', r.DETAIL)} THEN 'paper_detail' WHEN {has('lower(text)', r.MATCH)} THEN 'paper_match' ELSE 'paper_search' END"
ACADEMIC_ROUTER = f"""WITH a AS (SELECT *, {_PID} AS pid, {_YEAR} AS year FROM {_A}), i AS (SELECT *, {_case('lower(text)', r.ACADEMIC, _REST)} AS intent FROM a)
SELECT query_id, intent, pid AS paper_id, year, intent IN {r.LOOKUPS} AND pid = '' AS requires_lookup FROM i"""


def paper_id_extract(spark, sf):
    return academic_questions(spark, sf).select("query_id", r.paper_id(F.col("text")).alias("paper_id"))


def year_filter(spark, sf):
    return academic_questions(spark, sf).select("query_id", r.year_filter(F.col("text")).alias("year"))


def query_clean(spark, sf):
    return r.clean_query(academic_questions(spark, sf))


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_W = f"least(len(regexp_extract_all(part, '[A-Za-z][A-Za-z0-9_-]{{2,}}')), 8) * 12 + least(len(regexp_extract_all(part, '[一-龥]{{2,8}}')), 6) * 8 + {count('lower(part)', r.SEGMENT_TERMS)} * 20 - greatest(0, length(part) - 140) / 4.0"
_DROP = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]*\\|\\|[ \\t]*', ' || ', 'g'), '{r.INSTRUCTIONS}', ' ', 'g'), '{r.FOCUS}', ' ', 'g'), '{r.SECTIONS}', ' ', 'g')"
QUERY_CLEAN = f"""WITH p AS (SELECT query_id, text, list_filter(list_transform(regexp_split_to_array({_DROP}, '[ \\t]+\\|\\|[ \\t]+|[。；;\\n]'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS parts FROM {_A}),
u AS (SELECT query_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM p),
b AS (SELECT query_id, arg_max(part, ({_W}, -pos)) AS best FROM u GROUP BY query_id),
ts AS (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM (SELECT query_id, regexp_extract_all(best, '"[^"]+"|[A-Za-z][A-Za-z0-9_-]{{2,}}|[一-龥]{{2,8}}|[0-9]{{4}}') AS ts FROM b)),
k AS (SELECT *, lower(regexp_replace(term, '^"|"$', '', 'g')) AS key FROM ts),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY pos) AS f FROM k WHERE key NOT IN {r.QUERY_STOP}),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS j FROM o WHERE f = 1),
j AS (SELECT query_id, string_agg(term, ' ' ORDER BY pos) AS terms FROM m WHERE j <= 12 GROUP BY query_id)
SELECT p.query_id, coalesce(nullif({_STRIP.format("substring(coalesce(terms, best, ''), 1, 160)")}, ''), substring(text, 1, 160)) AS cleaned FROM p LEFT JOIN b USING (query_id) LEFT JOIN j USING (query_id)"""


def query_expand(spark, sf):
    return r.expand_query(academic_questions(spark, sf))


QUERY_EXPAND = f"""WITH a AS (SELECT query_id, {_STRIP.format("regexp_replace(text, '[ \\t]*\\|\\|[ \\t]*', ' ', 'g')")} AS w, list_filter(list_transform(regexp_split_to_array(text, '\\|\\|'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS parts FROM {_A}),
v AS (SELECT query_id, list_concat(parts, [w, w || ' site:arxiv.org', w || ' site:github.com', w || ' site:aclanthology.org']) AS vs FROM a),
u AS (SELECT query_id, variant, min(i) AS i FROM (SELECT query_id, unnest(vs) AS variant, generate_subscripts(vs, 1) AS i FROM v) GROUP BY query_id, variant)
SELECT query_id, CAST(pos AS INTEGER) AS pos, variant FROM (SELECT query_id, variant, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS pos FROM u) WHERE pos < 10"""


def research_intent(spark, sf):
    return r.research_intent(questions(spark, sf))


RESEARCH = f"""SELECT query_id, CASE WHEN {has('text', r.MEMORY_FIRST)} THEN 'memory_followup'
  WHEN {has('low', r.PURE_VERIFY)} AND NOT {has('low', r.PURE_VERIFY_NOT)} OR {has('low', r.SINGLE_PAPER)} AND {has('low', r.READING)} AND NOT {has('low', r.READING_NOT)} OR length(text) < 30 AND {has('low', r.SIMPLE)} THEN 'not_research'
  ELSE {_case('low', r.RESEARCH_INTENTS, "'not_research'")} END AS intent FROM (SELECT *, lower(text) AS low FROM {_Q})"""


#: Task types of plans that are made of conversations, one of them illegal.
_TYPES = (*r.TASK_TYPES, "make_coffee")
_MADE = f"""(SELECT * FROM {values_sql(literals.PLANS, 'plan_id, pos, id, type, depends_on')}
  UNION ALL SELECT conv_id + 100, turn + 1, 't' || turn, CAST({list(_TYPES)} AS VARCHAR[])[1 + (conv_id * 3 + turn * 4) % {len(_TYPES)}], CAST(['t' || ((conv_id + turn * 5) % 6)] AS VARCHAR[]) FROM conversations)"""


def plan_validation(spark, sf):
    """The literal plans, and a plan of each conversation with a task for every turn."""
    turn, conv = F.col("turn"), F.col("conv_id")
    kind = F.element_at(F.array(*(F.lit(t) for t in _TYPES)), (F.lit(1) + (conv * 3 + turn * 4) % len(_TYPES)).cast("int"))
    made = read(spark, sf, "conversations").select((conv + 100).alias("plan_id"), (turn + 1).alias("pos"), F.concat(F.lit("t"), turn).alias("id"), kind.alias("type"), F.array(F.concat(F.lit("t"), (conv + turn * 5) % 6)).alias("depends_on"))
    plans = literals.plans(spark).select(F.col("plan_id").cast("long"), F.col("pos").cast("long"), "id", "type", "depends_on")
    return r.validate_plan(plans.unionByName(made)).withColumn("depends_on", F.array_join("depends_on", ","))


PLAN_VALIDATION = f"""WITH t AS (SELECT *, type = 'verify_claims' AS v FROM {_MADE}),
s AS (SELECT *, count(*) OVER (PARTITION BY plan_id) AS n, row_number() OVER (PARTITION BY plan_id, v ORDER BY pos) AS k FROM t),
kept AS (SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY CASE WHEN n > 8 AND v THEN 1 ELSE 0 END, pos) AS pos, id, type, depends_on, v FROM s WHERE n <= 8 OR v AND k = 1 OR NOT v AND k <= 7),
w AS (SELECT plan_id, count(*) AS n, arg_max(id, pos) AS last, bool_or(v) AS ok FROM kept GROUP BY plan_id),
a AS (SELECT plan_id, pos, id, type, depends_on FROM kept UNION ALL SELECT plan_id, n + 1, 't' || (n + 1), 'verify_claims', [last] FROM w WHERE NOT ok),
i AS (SELECT plan_id, list(id) AS ids, sum(CAST(type IN {r.RETRIEVING} AS INTEGER)) AS ret, max(CAST(type NOT IN {r.TASK_TYPES} AS INTEGER)) AS bad FROM a GROUP BY plan_id)
SELECT a.plan_id, CAST(pos AS INTEGER) AS pos, id, type, array_to_string(list_filter(depends_on, lambda d: list_contains(ids, d)), ',') AS depends_on, CASE WHEN bad = 1 THEN 'illegal_type' WHEN ret > 5 THEN 'too_many_retrievals' ELSE '' END AS error FROM a JOIN i USING (plan_id)"""

_ALLOWED = [("intake", "memory"), ("memory", "planner"), ("planner", "local_search"), ("local_search", "grade"), ("grade", "synthesize"), ("grade", "web_search"), ("web_search", "synthesize"), ("synthesize", "verify"), ("verify", "finalize")]
_STEPS = [(k, p, a) for k, run in enumerate([["intake", "memory", "planner", "local_search", "grade", "synthesize", "verify", "finalize"], ["intake", "planner", "grade"], ["intake"]]) for p, a in enumerate(run)]


_NAMES = sorted({a for _, _, a in _STEPS})
_WALKS = f"""(SELECT * FROM {values_sql(_STEPS, 'run_id, pos, action')} UNION ALL SELECT conv_id + 100, turn, CAST({_NAMES} AS VARCHAR[])[1 + (conv_id * 5 + turn * 3) % {len(_NAMES)}] FROM conversations)"""


def action_audit(spark, sf):
    """The literal runs, and a run of each conversation with an action for every turn."""
    at = (F.lit(1) + (F.col("conv_id") * 5 + F.col("turn") * 3) % len(_NAMES)).cast("int")
    walks = read(spark, sf, "conversations").select((F.col("conv_id") + 100).alias("run_id"), F.col("turn").alias("pos"), F.element_at(F.array(*(F.lit(a) for a in _NAMES)), at).alias("action"))
    steps = spark.createDataFrame(_STEPS, "run_id long, pos long, action string").unionByName(walks)
    return r.topology_violations(steps, spark.createDataFrame(_ALLOWED, "src string, dst string"))


ACTION_AUDIT = f"""SELECT src, dst, run_id, pos FROM (SELECT run_id, pos, action AS src, lead(action) OVER (PARTITION BY run_id ORDER BY pos) AS dst FROM {_WALKS}) m
WHERE dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {values_sql(_ALLOWED, 'src, dst')} a WHERE a.src = m.src AND a.dst = m.dst)"""

QUERIES = {f.__name__: f for f in (rule_router, plan_merge, context_router, router_scores, paper_task_router, academic_router, paper_id_extract, year_filter, query_clean, query_expand, research_intent, plan_validation, action_audit)}
ORACLES = {
    "rule_router": RULE_ROUTER, "plan_merge": PLAN_MERGE, "context_router": CONTEXT_ROUTER, "router_scores": ROUTER_SCORES, "paper_task_router": PAPER_TASK, "academic_router": ACADEMIC_ROUTER,
    "paper_id_extract": f"SELECT query_id, {_PID} AS paper_id FROM {_A}", "year_filter": f"SELECT query_id, {_YEAR} AS year FROM {_A}", "query_clean": QUERY_CLEAN, "query_expand": QUERY_EXPAND, "research_intent": RESEARCH, "plan_validation": PLAN_VALIDATION, "action_audit": ACTION_AUDIT,
}
