"""Query routers and planners as Column expressions: one row for each query, one struct or set of columns for its plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_engine.functions import text as tx
from evidence_engine.sources.scratch import kept

# The rule router's word lists.
CASUAL = ("你好", "hello", "hi", "嗨", "谢谢", "你是谁", "早上好", "晚安", "再见", "ok", "好的")
GLOBAL = ("整体", "总体", "总结", "概览", "框架", "架构", "主要有哪些", "梳理一下", "综述", "全局", "都有哪些", "包含哪些", "分类", "体系", "全景")
RELATION = ("关系", "关联", "影响", "依赖", "联系", "路径", "为什么", "如何导致", "怎么配合", "链路", "原因", "之间", "互相", "因果", "传导")
STRUCTURE = ("围绕", "上下游", "局部", "模块", "组织", "组成")
LOCAL = ("围绕", "上下游", "局部")
SEMANTIC = ("怎么", "如何", "优化", "改进", "设计", "方案", "建议", "区别", "优缺点", "对比", "原理", "机制", "什么是", "解释")
SEMANTIC_GRAPH = ("架构", "框架", "模块", "上下游", "配合")
OPTIMIZE = ("优化", "改进", "建议")
RELATION_LOCAL = ("围绕", "上下游", "局部", "结构", "模块")
EXACT = "[A-Za-z_][A-Za-z0-9_]{2,}|[A-Z]{2,}"

#: Plans by rule: intent, graph method, bm25, vector and graph top-k, depth, confidence; a top-k of 0 is a route unused.
PLANS = {
    "short": ("chat", "none", 0, 0, 0, 1, 0.95),
    "casual": ("chat", "none", 0, 0, 0, 1, 0.95),
    "global_local": ("subgraph", "subgraph", 8, 10, 10, 2, 0.75),
    "global": ("global_summary", "none", 8, 10, 0, 1, 0.75),
    "structure": ("subgraph", "subgraph", 8, 10, 10, 2, 0.78),
    "relation_local": ("subgraph", "subgraph", 8, 8, 10, 2, 0.75),
    "relation": ("relation", "path", 8, 8, 10, 2, 0.75),
    "exact": ("fact", "ego", 10, 5, 6, 1, 0.8),
    "optimize_graph": ("optimize", "subgraph", 6, 10, 8, 1, 0.65),
    "optimize": ("optimize", "none", 6, 10, 0, 1, 0.65),
    "explain_graph": ("explain", "subgraph", 6, 10, 8, 1, 0.65),
    "explain": ("explain", "none", 6, 10, 0, 1, 0.65),
    "default": ("default", "ego", 6, 6, 6, 1, 0.55),
}
PLAN_FIELDS = ("intent", "graph_method", "bm25_top_k", "vector_top_k", "graph_top_k", "graph_depth", "confidence")


def rule_of(text: Column) -> Column:
    """The name of the first rule that a query meets."""
    q = tx.strip(text)
    low = F.lower(q)
    return (
        F.when(F.length(q) <= 2, "short")
        .when(tx.contains_any(low, CASUAL) & (F.length(q) <= 15), "casual")
        .when(tx.contains_any(q, GLOBAL), F.when(tx.contains_any(q, LOCAL), "global_local").otherwise("global"))
        .when(tx.contains_any(q, STRUCTURE), "structure")
        .when(tx.contains_any(q, RELATION), F.when(tx.contains_any(q, RELATION_LOCAL), "relation_local").otherwise("relation"))
        .when(q.rlike(EXACT), "exact")
        .when(tx.contains_any(q, SEMANTIC), F.concat(F.when(tx.contains_any(q, OPTIMIZE), "optimize").otherwise("explain"), F.when(tx.contains_any(q, SEMANTIC_GRAPH), "_graph").otherwise("")))
        .otherwise("default")
    )


def plan_table(spark: SparkSession) -> DataFrame:
    """The plans as a table: rule and the plan's fields, a row for each of the fixed rules."""
    kinds = "rule string, intent string, graph_method string, bm25_top_k int, vector_top_k int, graph_top_k int, graph_depth int, confidence double"
    return spark.createDataFrame([(rule, *plan) for rule, plan in PLANS.items()], kinds)


def rule_plan(queries: DataFrame) -> DataFrame:
    """queries with the rule and the plan's fields; entities are the query's terms if the rule is `exact`.

    Each query is classified once and written down with its terms; its plan then comes from the table of plans, which
    has as many rows as there are rules, so what reads a field of the plan doesn't repeat the rules.
    """
    terms = F.slice(F.array_distinct(tx.all_of(F.col("text"), "[A-Za-z_][A-Za-z0-9_]{2,}|[一-龥]{2,6}")), 1, 8)
    ruled = kept(queries.withColumn("rule", rule_of(F.col("text"))), "ruled-queries")
    out = ruled.join(F.broadcast(plan_table(queries.sparkSession)), "rule")
    return out.select(*ruled.columns, *PLAN_FIELDS, F.when(F.col("rule") == "exact", terms).otherwise(F.array().cast("array<string>")).alias("entities"))


def merge_plan(rules: DataFrame) -> DataFrame:
    """A proposed plan p_* over the rules' one: below a confidence of 0.45 the rules stand; lexical and vector search are
    never switched off; a path is two hops deep at least."""
    trust = F.coalesce(F.col("p_confidence"), F.lit(0.0)) >= 0.45
    method = F.when(trust & F.col("p_graph_method").isin("none", "ego", "path", "subgraph"), F.col("p_graph_method")).otherwise(F.col("graph_method"))
    depth = F.when(trust, F.coalesce(F.expr("try_cast(p_graph_depth AS INT)"), F.col("graph_depth"))).otherwise(F.col("graph_depth"))
    return rules.select("query_id", method.alias("graph_method"), (method != "none").alias("graph"), F.greatest(F.when(method == "path", 2).otherwise(1), F.least(depth, F.lit(3))).alias("graph_depth"), F.when(trust, F.col("p_confidence")).otherwise(F.col("confidence")).alias("confidence"))


# The context router.

# Word lists by feature, paths, aliases.
PAPER = ("论文", "paper", "arxiv", "摘要", "引言", "方法", "实验", "指标", "数据集", "相关工作", "引用", "reference", "citation", "作者", "结论", "消融", "开题", "大纲", "贡献", "局限", "不足", "创新点")
VERIFY = ("验证", "可靠", "依据", "证据", "是否真实", "有没有支撑", "查证", "是否可靠", "可靠吗", "证据是否充分", "verify", "reliable")
WEB = ("联网", "搜索", "上网查", "百度", "谷歌", "web search", "search")
RESEARCH = ("研究综述", "文献综述", "综述", "研究现状", "研究方向", "研究点", "研究空白", "开题报告", "跨论文", "多篇论文", "系统分析", "优化方案", "路线图", "技术路线", "架构设计", "设计", "拆解", "规划", "方案", "瓶颈", "升级", "选题", "研究主题", "可做", "roadmap", "survey", "research gap", "proposal")
COMPLEX = ("分析", "对比", "比较", "如何", "为什么", "区别", "差异", "联系", "关系", "结合", "整合", "评价", "总结", "归纳", "推导", "论证", "上下游", "路径", "影响", "详细说明", "explain", "analyze", "compare", "difference", "relationship")
COMPARE = ("对比", "比较", "差异", "区别", "vs", "versus", "compare", "difference")
DESIGN = ("设计", "架构", "方案", "路线", "技术路线", "拆解", "规划", "升级", "优化", "瓶颈", "roadmap", "proposal")
SIMPLE = ("是什么", "定义", "什么意思", "介绍一下", "what is")
CURRENT = ("这个结论", "该结论", "这个回答", "当前回答", "上述结论", "是否可靠", "可靠吗", "依据是什么", "证据是否", "有没有支撑")
OUTLINE = ("大纲", "提纲", "outline", "章节安排", "生成大纲")
OPENING = ("开题报告", "开题", "研究方案", "课题申报", "research proposal")
FRESH = ("最新", "当前", "现在", "2025", "2026", "fresh", "current", "latest")
SYSTEMS = ("self-rag", "graphrag", "crag", "rag", "agent")
SEPARATORS = ("、", ",", "，", " 和 ", "与", "及", "/", " vs ", " VS ")
FOLLOW_WEB = ("联网补充", "继续联网", "补充一下", "继续补充", "查一下", "搜索一下", "上网查一下", "帮我查", "帮我搜", "联网查", "联网搜")
FOLLOW_SHORT = "^(那|那么|继续|再|还有|这个|它|其|上面|刚才|前面)|(呢|怎么样|如何|为什么)$"
FOLLOW_LONG = "刚才|上面|前面|继续|这个|它|其"
PATHS = ("fast", "pipeline", "paper_assistant", "self_rag", "research")
ALIASES = {"simple": "fast", "complex": "pipeline", "paper": "paper_assistant", "crag": "self_rag", "research_workflow": "research"}


def normal_path(path: Column) -> Column:
    """A path's own name, an alias resolved; null if there is no such path."""
    out = F.when(path.isin(*PATHS), path)
    for alias, name in ALIASES.items():
        out = out.when(path == alias, name)
    return out


def is_follow_up(text: Column) -> Column:
    q = tx.strip(text)
    return (q != "") & (tx.contains_any(q, FOLLOW_WEB) | F.when(F.length(q) <= 12, q.rlike(FOLLOW_SHORT)).otherwise(q.rlike(FOLLOW_LONG)))


def features(queries: DataFrame) -> DataFrame:
    """queries(query_id, text) with the router's features."""
    text, low = F.col("text"), F.lower("text")
    out = queries.withColumns({"has_outline": tx.contains_any(low, OUTLINE), "has_opening": tx.contains_any(low, OPENING)})
    planned = F.col("has_outline") | F.col("has_opening")
    return out.withColumns({
        "has_research": tx.contains_any(low, RESEARCH) & ~planned, "has_compare": tx.contains_any(low, COMPARE), "has_design": tx.contains_any(low, DESIGN) & ~planned,
        "has_verify": tx.contains_any(low, VERIFY), "has_fresh": tx.contains_any(low, FRESH), "has_web": tx.contains_any(low, WEB), "has_paper": tx.contains_any(low, PAPER),
        "has_complex": tx.contains_any(low, COMPLEX), "has_simple": tx.contains_any(low, SIMPLE), "current_object": tx.contains_any(low, CURRENT),
        "multi": (F.size(tx.all_of(text, "[A-Za-z][A-Za-z0-9_-]{2,}")) >= 2) | tx.contains_any(text, SEPARATORS), "n": F.length(text),
    })


def path_scores(feats: DataFrame) -> DataFrame:
    """feats with the five paths' scores, in hundredths; the steps' order matters where a score is capped."""
    c = F.col
    add = lambda cond, x: F.when(cond, x).otherwise(0)
    fast = 20 + F.when((c("n") < 30) & c("has_simple"), 100).when(c("n") < 30, 45).otherwise(0)
    fast = F.when(c("has_paper"), F.least(fast, F.lit(45))).otherwise(fast)
    systems = c("has_compare") & c("multi") & tx.contains_any(F.lower("text"), SYSTEMS)
    pipeline = 25 + add(c("has_complex"), 55) + add(c("has_compare"), 20) + add(c("multi"), 20) - add(systems, 20)
    alone = c("has_paper") & ~(c("has_design") | c("has_research") | c("multi") | c("has_verify"))
    many = c("has_opening") & (F.contains("text", F.lit("多篇论文")) | F.contains("text", F.lit("研究空白")) | c("multi"))
    paper = add(c("has_paper"), 65) + add(alone, 35) + F.when(c("has_opening"), 75).when(c("has_outline"), 55).otherwise(0) - add(many, 55)
    paper = paper - add(c("has_verify") & ~(c("has_design") | c("has_research")), 30)
    rag = add(c("has_verify"), 75) + add(c("current_object"), 65) + add(c("has_fresh") & ~c("has_web"), 45) - add(c("has_design") | c("has_research"), 35)
    research = add(many, 125) + add(c("has_research"), 85) + add(c("has_design"), 65) + add(c("has_compare") & c("multi"), 75) + add(systems, 35)
    research = research + add(c("has_paper") & (c("has_research") | c("multi")), 35) + add(c("has_verify") & c("has_design"), 35) + add((c("n") > 45) & (c("has_complex") | c("has_design")), 25)
    out = feats.withColumns({"s_research": research, "s_pipeline": pipeline, "s_paper_assistant": paper, "s_self_rag": rag})
    return out.withColumn("s_fast", F.when(c("s_research") >= 90, F.least(fast, F.lit(25))).otherwise(fast))


# The paper intents' words, in order.
PAPER_INTENTS = (
    ("paper_experiment", ("实验", "指标", "数据集", "消融", "benchmark")),
    ("paper_method", ("方法", "模型", "算法", "框架", "公式")),
    ("paper_compare", ("对比", "比较", "区别", "差异", "vs")),
    ("paper_literature_review", ("相关工作", "综述", "引用", "reference")),
    ("paper_opening_report", ("开题报告", "开题", "研究方案", "课题申报", "research proposal")),
    ("paper_outline", ("大纲", "提纲", "outline")),
    ("paper_contribution", ("贡献", "创新点")),
    ("paper_limitation", ("局限", "不足", "限制")),
)


def first_match(low: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], otherwise: Column | str) -> Column:
    out = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    for name, words in reversed(rules):
        out = F.when(tx.contains_any(low, words), name).otherwise(out)
    return out


def context_route(queries: DataFrame) -> DataFrame:
    """query_id, path, intent, context_dependent, level of queries(query_id, text, force_path, last_path, last_intent)."""
    scored = path_scores(features(queries))
    low, forced, last = F.lower("text"), normal_path(F.col("force_path")), normal_path(F.col("last_path"))
    follows = forced.isNull() & is_follow_up(F.col("text")) & last.isNotNull()
    top = F.greatest(*(F.col(f"s_{p}") for p in PATHS))
    best = F.coalesce(*(F.when(F.col(f"s_{p}") == top, p) for p in PATHS))
    path = F.coalesce(forced, F.when(follows, last), best)
    paper = first_match(low, PAPER_INTENTS, "paper_overview")
    inherited = F.when(last == "paper_assistant", paper).when((last == "self_rag") & tx.contains_any(low, VERIFY), "verify_or_freshness").otherwise(F.coalesce(F.nullif("last_intent", F.lit("")), F.lit("followup")))
    own = (
        F.when(path == "research", F.when(F.col("has_design"), "research_design").otherwise("research_planning"))
        .when(path == "self_rag", "verify_or_freshness").when(path == "paper_assistant", paper).when(path == "pipeline", "complex_analysis")
        .otherwise(F.when(F.col("has_simple") | (F.col("n") < 30), "fact_qa").otherwise("general_qa"))
    )
    level = F.when(path == "fast", "minimal").when(path.isin("self_rag", "research"), "verbose").otherwise("normal")
    return scored.select("query_id", path.alias("path"), F.when(forced.isNotNull(), F.concat(F.lit("force_"), forced)).when(follows, inherited).otherwise(own).alias("intent"), follows.alias("context_dependent"), level.alias("level"))


def last_route(turns: DataFrame) -> DataFrame:
    """query_id, last_path, last_intent: of the last assistant turn (query_id, pos, role, path, intent) with a path."""
    known = turns.where("role = 'assistant' and path is not null and path <> ''")
    return known.groupBy("query_id").agg(F.max_by("path", "pos").alias("last_path"), F.max_by(F.coalesce("intent", F.lit("followup")), "pos").alias("last_intent"))


# The paper-task router.

# Words by task in the scores' order, and the words that decide at once, in order.
TASK_WORDS = {
    "literature_review": ("相关工作", "文献综述", "综述", "研究现状", "研究背景", "literature review", "related work", "survey"),
    "compare": ("对比", "比较", "区别", "不同", "差异", "优缺点", "vs", "versus", "compare", "difference"),
    "experiment": ("实验", "结果", "指标", "数据集", "消融", "benchmark", "bleu", "accuracy", "f1", "rouge", "dataset", "ablation"),
    "method": ("方法", "模型", "算法", "框架", "公式", "代码", "怎么做", "如何实现", "method", "model", "algorithm", "architecture"),
    "opening_report": ("开题报告", "开题", "研究方案", "课题申报", "proposal", "research proposal"),
    "outline": ("大纲", "论文结构", "写作思路", "章节安排", "提纲", "outline"),
    "overview": ("主要解决", "贡献", "创新点", "讲了什么", "总结一下", "概述", "是什么", "overview", "summary", "contribution"),
}
TASK_DECIDERS = (
    ("opening_report", ("开题报告", "研究方案", "课题申报", "research proposal", "proposal")),
    ("outline", ("大纲", "提纲", "outline", "生成大纲", "章节安排")),
    ("literature_review", ("综述", "研究现状", "相关工作", "文献综述")),
    ("compare", ("区别", "不同", "差异", "对比", "比较", "vs", "versus", "compare")),
    ("experiment", TASK_WORDS["experiment"]),
)
PAPER_HINTS = ("论文", "paper", "arxiv", "作者", "摘要", "引言", "结论", "reference", "citation")
#: Preferred chunk types by task.
PREFERRED = {
    "overview": ("abstract", "introduction", "conclusion"),
    "method": ("method", "equation", "code", "paragraph"),
    "experiment": ("experiment", "table", "paragraph"),
    "literature_review": ("related_work", "reference", "method", "abstract"),
    "compare": ("method", "experiment", "table"),
    "opening_report": ("abstract", "introduction", "related_work", "method", "experiment", "conclusion"),
    "outline": ("abstract", "introduction", "method", "experiment", "conclusion"),
}


def paper_task(queries: DataFrame) -> DataFrame:
    """query_id, task, preferred (chunk types, comma-joined)."""
    low = F.lower(F.coalesce("text", F.lit("")))
    scores = {t: tx.count_of(low, w) for t, w in TASK_WORDS.items()}
    top = F.greatest(*scores.values())
    task = F.coalesce(*(F.when(s == top, t) for t, s in scores.items()))
    for name, words in reversed(TASK_DECIDERS):
        task = F.when((scores[name] > 0) & tx.contains_any(low, words), name).otherwise(task)
    task = F.when(top <= 0, F.when(tx.contains_any(low, PAPER_HINTS), "overview").otherwise("paper_qa")).otherwise(task)
    liked = F.lit("")
    for name, kinds in PREFERRED.items():
        liked = F.when(F.col("task") == name, ",".join(kinds)).otherwise(liked)
    return queries.select("query_id", task.alias("task")).withColumn("preferred", liked)


# Academic search.

# Intents and their words in order; the id patterns in order.
ACADEMIC = (
    ("paper_verify", ("真实", "真假", "是否存在", "是真的吗", "是否真实", "verify", "real paper", "exist")),
    ("related_papers", ("相关论文", "类似论文", "相关文献", "参考论文", "related papers", "related work")),
    ("paper_citations", ("引用", "被引", "cited by", "citations", "citation")),
    ("paper_references", ("参考文献", "参考了", "references", "reference list", "bibliography")),
    ("paper_recommendations", ("推荐", "类似", "相似", "similar", "recommend")),
    ("snippet_search", ("片段", "正文", "全文中", "论文中", "snippet", "text span")),
    ("author_search", ("作者", "学者", "author", "researcher")),
)
DETAIL = ("详情", "元数据", "metadata", "detail")
MATCH = ("精确", "标题", "题名", "match", "exact")
LOOKUPS = ("paper_verify", "related_papers", "paper_citations", "paper_references", "paper_recommendations", "paper_detail")
_ID = "[0-9]{4}[.][0-9]{4,5}(?:v[0-9]+)?"
PAPER_IDS = (
    ("", f"(?i)ARXIV[:：]?[ \\t]*({_ID})"),
    ("", f"(?i)arxiv[.]org/(?:abs|pdf|html)/({_ID})"),
    ("DOI:", "(?i)DOI[:：]?[ \\t]*([^ \\t\\r\\n，,；;]+/[^ \\t\\r\\n，,；;]+)"),
    ("PMID:", "(?i)PMID[:：]?[ \\t]*([0-9]+)"),
    ("", "(?i)(?:^|[^A-Za-z0-9_])([a-f0-9]{40})(?:$|[^A-Za-z0-9_])"),
    ("", f"(?i)(?:^|[^A-Za-z0-9_])({_ID})(?:$|[^A-Za-z0-9_])"),
)


def paper_id(text: Column) -> Column:
    """The first pattern's match, with its prefix; empty if none matches."""
    out = F.lit("")
    for prefix, pattern in reversed(PAPER_IDS):
        got = F.regexp_extract(text, pattern, 1)
        out = F.when(got != "", F.concat(F.lit(prefix), got)).otherwise(out)
    return out


def year_filter(text: Column, this_year: int = 2026) -> Column:
    """`2020-2026` for "since 2020", `2018-2021` for a range; null if there is none."""
    low = F.lower(text)
    since = F.regexp_extract(low, "(20[0-9]{2})[ \\t]*年?[ \\t]*(以后|以来|之后|及以后|至今|以降|后|after|since)", 1)
    since2 = F.regexp_extract(low, "(after|since)[ \\t]+(20[0-9]{2})", 2)
    span = "(20[0-9]{2})[ \\t]*[-—~至到][ \\t]*(20[0-9]{2})"
    start = F.coalesce(F.nullif(since, F.lit("")), F.nullif(since2, F.lit("")))
    return F.when(start.isNotNull(), F.concat(start, F.lit(f"-{this_year}"))).when(F.regexp_extract(low, span, 1) != "", F.concat(F.regexp_extract(low, span, 1), F.lit("-"), F.regexp_extract(low, span, 2)))


def academic_route(queries: DataFrame) -> DataFrame:
    """query_id, intent, paper_id, year, requires_lookup."""
    text, low = F.col("text"), F.lower("text")
    rest = F.when((paper_id(text) != "") | tx.contains_any(low, DETAIL), "paper_detail").when(tx.contains_any(low, MATCH), "paper_match").otherwise("paper_search")
    intent = first_match(low, ACADEMIC, rest)
    return queries.select("query_id", intent.alias("intent"), paper_id(text).alias("paper_id"), year_filter(text).alias("year"), (intent.isin(*LOOKUPS) & (paper_id(text) == "")).alias("requires_lookup"))


# What query cleaning drops, and the terms that make a segment worth more.
INSTRUCTIONS = "联网|搜索|查询|查找|帮我|请|一下|可以|补充内容|最新|论文|文献"
FOCUS = "重点找|优先找|尤其是|围绕|关于|相关的|相关"
SECTIONS = "研究现状|研究背景|相关工作|研究空白|参考论文|参考文献|依据|综述|开题"
SEGMENT_TERMS = ("rag", "retrieval", "augmented", "multi-agent", "agent", "llm", "medical", "biomedical", "clinical")
QUERY_STOP = ("帮我", "请你", "可以", "一下", "这个", "该选题", "选题", "内容", "重点", "优先", "研究", "分析", "find", "search", "paper", "papers", "latest", "related", "about", "with", "using")


def clean_query(queries: DataFrame, most: int = 12, chars: int = 160) -> DataFrame:
    """query_id, cleaned: instructions dropped, the best segment's first distinct terms."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t]*\|\|[ \t]*", " || ")
    for words in (INSTRUCTIONS, FOCUS, SECTIONS):
        text = F.regexp_replace(text, words, " ")
    parts = F.filter(F.transform(F.split(text, r"[ \t]+\|\|[ \t]+|[。；;\n]"), tx.strip), lambda p: p != "")

    def worth(p: Column) -> Column:
        words = F.least(F.size(tx.all_of(p, "[A-Za-z][A-Za-z0-9_-]{2,}")), F.lit(8)) * 12 + F.least(F.size(tx.all_of(p, "[一-龥]{2,8}")), F.lit(6)) * 8
        return words + tx.count_of(F.lower(p), SEGMENT_TERMS) * 20 - F.greatest(F.lit(0), F.length(p) - 140) / 4

    rows = queries.select("query_id", "text", F.posexplode_outer(parts).alias("pos", "part")).withColumn("w", worth(F.col("part")))
    best = rows.groupBy("query_id", "text").agg(F.max_by("part", F.struct("w", -F.col("pos"))).alias("best"))
    found = tx.all_of(F.col("best"), '"[^"]+"|[A-Za-z][A-Za-z0-9_-]{2,}|[一-龥]{2,8}|[0-9]{4}')
    key = lambda t: F.lower(F.regexp_replace(t, '^"|"$', ""))
    terms = best.select("query_id", "text", "best", F.posexplode_outer(F.filter(found, lambda t: ~key(t).isin(*QUERY_STOP))).alias("pos", "term"))
    first = F.row_number().over(Window.partitionBy("query_id", key(F.col("term"))).orderBy("pos"))
    once = terms.withColumn("f", first).where("f = 1 or term is null")
    joined = once.groupBy("query_id", "text", "best").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("pos", "term")))), lambda x: x["term"]), 1, most), " ").alias("terms"))
    return joined.select("query_id", F.coalesce(F.nullif(tx.strip(F.substring(F.coalesce(F.nullif("terms", F.lit("")), "best", F.lit("")), 1, chars)), F.lit("")), F.substring("text", 1, chars)).alias("cleaned"))


def expand_query(queries: DataFrame, most: int = 10) -> DataFrame:
    """query_id, pos, variant: the query's `||` parts, then site variants of the whole, distinct in order."""
    whole = tx.strip(F.regexp_replace("text", r"[ \t]*\|\|[ \t]*", " "))
    parts = F.filter(F.transform(F.split("text", r"\|\|"), tx.strip), lambda p: p != "")
    sites = F.array(*(F.concat(whole, F.lit(f" site:{s}")) for s in ("arxiv.org", "github.com", "aclanthology.org")))
    return queries.select("query_id", F.posexplode(F.slice(F.array_distinct(F.concat(parts, F.array(whole), sites)), 1, most)).alias("pos", "variant"))


# Research.

# Words of the research intents, in order, and of the tests before them.
MEMORY_FIRST = ("刚才", "之前", "前文", "上面", "继续", "回到", "我们确定", "已确定", "这个选题", "该选题", "这个方案", "这个研究", "不看前文", "刚刚")
RESEARCH_INTENTS = (
    ("literature_review", ("文献综述", "研究综述", "综述", "研究现状", "相关工作", "survey", "literature review")),
    ("method_comparison", ("对比", "比较", "差异", "区别", "vs", "compare", "difference")),
    ("gap_analysis", ("研究空白", "空白", "创新点", "gap", "underexplored")),
    ("proposal_design", ("开题", "研究方案", "技术路线", "路线图", "架构设计", "实验设计", "proposal", "roadmap")),
    ("direction_exploration", ("研究方向", "研究点", "选题", "可做", "方向", "探索")),
    ("direction_exploration", ("研究", "论文", "文献", "方法", "rag", "graphrag", "self-rag", "crag", "agent")),
)
PURE_VERIFY = ("可靠吗", "是否可靠", "验证", "查证", "证据支撑", "有没有支撑")
PURE_VERIFY_NOT = ("研究空白", "研究方案", "技术路线", "文献综述", "开题")
SINGLE_PAPER = ("这篇论文", "该论文", "这篇paper", "this paper")
READING = ("方法是什么", "实验", "贡献", "局限", "总结", "摘要", "讲了什么", "怎么做")
READING_NOT = ("比较", "对比", "研究空白", "技术路线", "开题", "方案")


def research_intent(queries: DataFrame) -> DataFrame:
    """query_id, intent: one of the research intents, memory_followup or not_research."""
    text, low = F.col("text"), F.lower("text")
    verify = tx.contains_any(low, PURE_VERIFY) & ~tx.contains_any(low, PURE_VERIFY_NOT)
    single = tx.contains_any(low, SINGLE_PAPER) & tx.contains_any(low, READING) & ~tx.contains_any(low, READING_NOT)
    simple = (F.length(text) < 30) & tx.contains_any(low, SIMPLE)
    intent = F.when(tx.contains_any(text, MEMORY_FIRST), "memory_followup").when(verify | single | simple, "not_research").otherwise(first_match(low, RESEARCH_INTENTS, "not_research"))
    return queries.select("query_id", intent.alias("intent"))


# Legal task types and those that retrieve.
TASK_TYPES = ("retrieve_papers", "retrieve_kg_context", "summarize_evidence", "summarize_method", "compare_methods", "extract_experiments", "find_research_gap", "generate_outline", "generate_proposal", "verify_claims")
RETRIEVING = ("retrieve_papers", "retrieve_kg_context")


def validate_plan(tasks: DataFrame, cap: int = 8, retrievals: int = 5) -> DataFrame:
    """Tasks (plan_id, pos, id, type, depends_on) made legal, with the plan's error if it can't be.

    Over `cap` tasks, the first cap - 1 that don't verify and the first that does stay; a plan without verify_claims gets
    one behind its last task; dependencies on tasks that aren't there go. Unknown types and over `retrievals` retrieving
    tasks are errors.
    """
    verify = F.col("type") == "verify_claims"
    by_plan = Window.partitionBy("plan_id")
    place = F.row_number().over(Window.partitionBy("plan_id", verify).orderBy("pos"))
    seen = tasks.withColumn("n", F.count("*").over(by_plan)).withColumn("k", place)
    kept = seen.where((F.col("n") <= cap) | (verify & (F.col("k") == 1)) | (~verify & (F.col("k") <= cap - 1)))
    # What was cut to size keeps its verifying task behind the others.
    kept = kept.withColumn("pos", F.row_number().over(by_plan.orderBy(F.when((F.col("n") > cap) & verify, 1).otherwise(0), "pos"))).select("plan_id", "pos", "id", "type", "depends_on")
    whole = kept.groupBy("plan_id").agg(F.count("*").alias("n"), F.max_by("id", "pos").alias("last"), F.max(verify).alias("verified"))
    added = whole.where("not verified").select("plan_id", (F.col("n") + 1).cast("int").alias("pos"), F.concat(F.lit("t"), (F.col("n") + 1).cast("string")).alias("id"), F.lit("verify_claims").alias("type"), F.array("last").alias("depends_on"))
    out = kept.unionByName(added)
    ids = out.groupBy("plan_id").agg(F.collect_set("id").alias("ids"), F.sum(F.col("type").isin(*RETRIEVING).cast("int")).alias("retrieving"), F.max((~F.col("type").isin(*TASK_TYPES)).cast("int")).alias("unknown"))
    error = F.when(F.col("unknown") == 1, "illegal_type").when(F.col("retrieving") > retrievals, "too_many_retrievals").otherwise("")
    return out.join(ids, "plan_id").select("plan_id", "pos", "id", "type", F.filter("depends_on", lambda d: F.array_contains("ids", d)).alias("depends_on"), error.alias("error"))


def topology_violations(steps: DataFrame, allowed: DataFrame) -> DataFrame:
    """Transitions of steps(run_id, pos, action) that are not among allowed(src, dst)."""
    after = F.lead("action").over(Window.partitionBy("run_id").orderBy("pos"))
    moves = steps.select("run_id", "pos", F.col("action").alias("src"), after.alias("dst")).where("dst is not null")
    return moves.join(allowed, ["src", "dst"], "left_anti")
