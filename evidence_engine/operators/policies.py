"""Gates and policies between the stages: overrides, when to ask further, which search, which step comes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions import text as tx
from evidence_engine.operators import graph
from evidence_engine.operators import routing as r

# Words of the gates.
AMBIGUOUS = ("这个", "那个", "它", "它们", "这块", "上面", "刚才", "前面")
VERIFY_TERMS = ("验证", "证据", "是否充分", "可靠吗", "可靠性", "依据", "paper", "论文", "benchmark", "评测")
METHOD_TERMS = ("self-rag", "crag", "graphrag")
PAPER_MODE = ("论文", "文献", "paper", "papers", "survey", "related work", "研究现状", "研究背景", "相关工作", "引用", "参考文献")
WEB_MODE = ("官网", "官方", "政策", "公告", "报告", "github", "新闻", "行业资料", "行业", "公司", "产品", "文档", "official", "policy", "announcement", "report", "news", "industry")
FOLLOW_LONG = ("联网补充", "继续联网", "补充一下", "继续补充", "查一下", "搜索一下", "验证一下", "可靠吗", "依据")
FOLLOW_SHORT = ("继续", "上面", "刚才", "这个", "它")
FRESH = ("最新", "近年", "2025", "2026", "当前")
ONE_PAPER = ("这篇论文", "该论文", "某篇论文", "论文a", "论文 a", "已入库论文")
LOCAL_PAPERS = ("literature_review", "method_comparison", "gap_analysis", "proposal_design")


def model_gate(plans: DataFrame) -> DataFrame:
    """query_id, ask: whether a rule plan is uncertain enough to ask a model."""
    q = tx.strip(F.col("text"))
    kinds = sum(tx.contains_any(q, w).cast("int") for w in (r.GLOBAL, r.RELATION, r.SEMANTIC))
    ask = (
        F.when(F.col("intent") == "chat", False).when((F.length(q) <= 12) & F.col("intent").isin("fact", "exact"), False)
        .when(tx.contains_any(q, AMBIGUOUS) | (F.length(q) >= 25) | (kinds >= 2) | (F.col("confidence") < 0.65), True)
        .otherwise(F.col("graph_method").isin("path", "subgraph"))
    )
    return plans.select("query_id", ask.alias("ask"))


def override_plan(plans: DataFrame, overrides: DataFrame) -> DataFrame:
    """plans with overrides(query_id, o_bm25_top_k, ..., strings): numbers clamped to 1..20, what can't be read is left."""
    rows = plans.join(overrides, "query_id", "left")
    read = lambda c: F.expr(f"try_cast(o_{c} AS INT)")
    top = lambda c: F.when(read(c).isNotNull(), F.greatest(F.lit(1), F.least(F.lit(20), read(c)))).otherwise(F.col(c)).alias(c)
    method = F.when(F.col("o_graph_method").isin("none", "ego", "path", "subgraph"), F.col("o_graph_method")).otherwise(F.col("graph_method"))
    intent = F.coalesce(F.nullif(tx.strip(F.col("o_intent")), F.lit("")), F.col("intent"))
    liked = F.slice(F.filter(F.coalesce("o_preferred", F.array().cast("array<string>")), lambda x: tx.strip(x) != ""), 1, 8)
    return rows.select("query_id", *(top(c) for c in ("bm25_top_k", "vector_top_k", "graph_top_k", "graph_depth")), method.alias("graph_method"), intent.alias("intent"), F.array_join(liked, ",").alias("preferred"))


def search_mode(text: Column) -> Column:
    """academic, web or mixed, by the words of a query."""
    low = F.lower(text)
    papers, web = tx.contains_any(low, PAPER_MODE), tx.contains_any(low, WEB_MODE)
    return F.when(papers & web, "mixed").when(papers, "academic").otherwise("web")


def needs_verification(text: Column) -> Column:
    return tx.contains_any(F.lower(text), VERIFY_TERMS) & tx.contains_any(F.lower(text), METHOD_TERMS)


def is_short_follow_up(text: Column) -> Column:
    t = tx.strip(F.coalesce(text, F.lit("")))
    return F.when(t == "", False).when(tx.contains_any(t, FOLLOW_LONG), F.length(t) <= 24).otherwise((F.length(t) <= 12) & tx.contains_any(t, FOLLOW_SHORT))


def contextual_query(queries: DataFrame, turns: DataFrame) -> DataFrame:
    """query_id, query: a follow-up gets the last user turn that isn't one itself as its topic."""
    told = turns.where((F.col("role") == "user") & (tx.strip(F.col("content")) != "") & ~is_short_follow_up(F.col("content")))
    topic = told.groupBy("query_id").agg(F.max_by(tx.strip(F.col("content")), "pos").alias("topic"))
    rows = queries.join(topic, "query_id", "left")
    return rows.select("query_id", F.when(is_short_follow_up(F.col("text")) & F.col("topic").isNotNull(), F.concat("topic", F.lit("\n"), "text")).otherwise(F.col("text")).alias("query"))


def planned_actions(queries: DataFrame) -> DataFrame:
    """query_id, actions (in order) of queries(query_id, text, intent)."""
    text, low, intent = F.col("text"), F.lower("text"), F.col("intent")
    external = tx.contains_any(low, r.WEB) | tx.contains_any(text, FRESH)
    single = (intent == "method_comparison") & tx.contains_any(low, ONE_PAPER)
    steps = F.array(
        F.when(intent.isin(*LOCAL_PAPERS), "search_local_papers").when(intent == "direction_exploration", "search_local_knowledge"),
        F.when(external, "search_academic_or_web"), F.when(single, "analyze_single_paper"), F.lit("synthesize_research"), F.lit("verify_claims"), F.lit("final_answer"),
    )
    return queries.select("query_id", F.array_compact(steps).alias("actions"))


def next_step(states: DataFrame) -> DataFrame:
    """query_id, next after the local search of states(query_id, actions, intent, n_evidence, fresh)."""
    thin = F.col("intent").isin("literature_review", "gap_analysis", "proposal_design") & ((F.col("n_evidence") == 0) | (F.col("fresh") & (F.col("n_evidence") < 3)))
    has = lambda a: F.array_contains("actions", a)
    step = F.when(has("search_academic_or_web") | thin, "external_search").when(has("analyze_single_paper"), "paper_analysis").otherwise("observation")
    return states.select("query_id", step.alias("next"))


#: The chain of tasks of a plan that nobody made.
FALLBACK_TASKS = ("retrieve_papers", "summarize_evidence", "compare_methods", "find_research_gap", "generate_proposal", "verify_claims")


def fallback_plan(queries: DataFrame) -> DataFrame:
    """query_id, pos, id, type, depends_on: six tasks in a row."""
    rows = queries.select("query_id", F.posexplode(F.array(*(F.lit(t) for t in FALLBACK_TASKS))).alias("k", "type"))
    return rows.select("query_id", (F.col("k") + 1).alias("pos"), F.concat(F.lit("t"), (F.col("k") + 1).cast("string")).alias("id"), "type", F.when(F.col("k") == 0, "").otherwise(F.concat(F.lit("t"), F.col("k").cast("string"))).alias("depends_on"))


def verify_answer(rows: DataFrame) -> DataFrame:
    """query_id, supported, action: without a model, an answer stands if there is any context or web evidence."""
    ok = (tx.strip(F.col("answer")) != "") & ((tx.strip(F.col("context")) != "") | (F.col("n_web") > 0))
    return rows.select("query_id", ok.alias("supported"), F.when(ok, "answer").otherwise("refuse").alias("action"))


def merge_evidence(lists: DataFrame, most: int = 10, preferred: Column | None = None) -> DataFrame:
    """query_id, place, evidence_id of lists(query_id, list, pos, evidence_id, chunk_type): the lists in order, preferred
    types first, each piece once."""
    liked = F.lit(0) if preferred is None else F.when(F.array_contains(preferred, F.col("chunk_type")), 0).otherwise(1)
    rows = lists.withColumn("liked", liked)
    first = F.row_number().over(Window.partitionBy("query_id", "evidence_id").orderBy("list", "pos"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("liked", "list", "pos"))
    return rows.withColumn("first", first).where("first = 1").withColumn("place", place).where(F.col("place") <= most).select("query_id", "place", "evidence_id")


def related_papers(original: DataFrame, groups: DataFrame, fallback: DataFrame) -> DataFrame:
    """query_id, source, paper_id: the original, then references, citations and recommendations (groups); a query with
    none of these gets the fallback search's papers."""
    found = groups.select("query_id", "source", "paper_id")
    rest = fallback.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit("search").alias("source"), "paper_id")
    return original.select("query_id", F.lit("original").alias("source"), "paper_id").unionByName(found).unionByName(rest)


def paper_url() -> Column:
    """A paper row's (arxiv_id, doi, author_id, paper_id) best URL; empty if it has no id."""
    link = lambda base, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(base), c))
    return F.coalesce(link("https://arxiv.org/abs/", "arxiv_id"), link("https://doi.org/", "doi"), link("https://www.semanticscholar.org/author/", "author_id"), link("https://www.semanticscholar.org/paper/", "paper_id"), F.lit(""))


# Relations and node types that a query on papers asks for, by word.
RELATIONS = (
    (("章节", "结构", "大纲", "section", "outline"), ("PAPER_HAS_SECTION", "CHILD_SECTION", "SECTION_HAS_CHUNK")),
    (("实验", "数据集", "指标", "评估", "dataset", "metric", "benchmark"), ("METHOD_EVALUATED_ON_DATASET", "METHOD_REPORTED_METRIC", "SECTION_HAS_TABLE", "SECTION_HAS_CHUNK")),
    (("方法", "模型", "算法", "method", "model"), ("PAPER_HAS_METHOD", "SECTION_HAS_CODE", "SECTION_HAS_CHUNK")),
    (("引用", "参考文献", "相关工作", "citation", "reference"), ("PAPER_CITES_PAPER", "SECTION_HAS_REFERENCE", "SECTION_HAS_CHUNK")),
)
TARGETS = (
    (("数据集", "dataset", "benchmark"), "dataset"), (("指标", "metric", "bleu", "f1", "accuracy"), "metric"), (("表格", "table", "结果"), "table"), (("代码", "code"), "code"), (("引用", "参考文献", "reference"), "reference"),
)


def relation_filter(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.when(tx.contains_any(text, words), F.array(*(F.lit(x) for x in rel))).otherwise(none) for words, rel in RELATIONS)))


def target_types(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(tx.contains_any(text, words), kind) for words, kind in TARGETS)))


def resolve_seeds(queries: DataFrame, nodes: DataFrame, names_most: int = 8, per_name: int = 5, limit: int = 8, given: DataFrame | None = None) -> DataFrame:
    """query_id, place, node_id: the given nodes (query_id, place, node_id) first, then those of queries(query_id, names) by
    name, the most confident of each, in the names' order, each once."""
    asked = queries.select("query_id", F.posexplode(F.slice("names", 1, names_most)).alias("k", "name")).withColumn("key", F.lower(tx.strip(F.col("name")))).where("key <> ''")
    met = graph.named_like(asked.select("key").distinct(), nodes).join(nodes.select("node_id", "confidence"), "node_id")
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("confidence"), "node_id"))
    top = met.withColumn("n", best).where(F.col("n") <= per_name).select("key", "node_id", "n")
    rows = asked.join(top, "key").select("query_id", "node_id", "k", "n")
    if given is not None:
        rows = rows.unionByName(given.select("query_id", "node_id", F.lit(-1).alias("k"), F.col("place").cast("int").alias("n")))
    first = F.row_number().over(Window.partitionBy("query_id", "node_id").orderBy("k", "n"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("k", "n"))
    return rows.withColumn("f", first).where("f = 1").withColumn("place", place).where(F.col("place") <= limit).select("query_id", "place", "node_id")
