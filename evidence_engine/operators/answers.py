"""What stands behind an answer: evidence gathered and cited, sources listed, a paper's evidence graded, external results
accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions import text as tx
from evidence_engine.operators import evidence

# Chunk types that a paper task needs, its number of context lines, words that ask for fresh or external
# evidence, actions of a grade, and results that are known by their names.
REQUIRED = {"overview": ("abstract",), "method": ("method",), "experiment": ("experiment",), "compare": ("method", "experiment"), "literature_review": ("related_work", "reference"), "opening_report": ("abstract", "introduction", "method"), "outline": ("abstract", "method", "experiment")}
CONTEXT_LINES = {"overview": 6, "method": 6, "experiment": 6, "compare": 8, "literature_review": 8, "opening_report": 10, "outline": 6}
PAPER_FRESH = ("最新", "当前", "近期", "现在", "2026", "version", "release", "changelog", "benchmark")
EXTERNAL = ("依据", "证据", "文献", "论文", "研究现状", "研究背景", "研究空白", "最新", "当前", "近三年", "可靠吗", "可靠性")
ASKS_WEB = ("联网", "搜索", "上网查", "web search", "search", "补充内容")
ACTIONS = ("answer", "rewrite_local", "adjust_strategy", "web_verify", "refuse")
KNOWN = (
    (("self-rag", "self rag", "asai"), "https://arxiv.org/abs/2310.11511", "Self-RAG: Learning to Retrieve, Generate, and Critique through Self-Reflection", 980),
    (("crag", "corrective retrieval"), "https://arxiv.org/abs/2401.15884", "Corrective Retrieval Augmented Generation", 960),
    (("graphrag", "graph rag"), "https://www.microsoft.com/en-us/research/project/graphrag/", "Project GraphRAG - Microsoft Research", 940),
    (("multi-agent", "multi agent", "多agent", "多智能体"), "https://arxiv.org/abs/2402.01680", "Large Language Model based Multi-Agents: A Survey of Progress and Challenges", 960),
    (("multi-agent", "multi agent", "多agent", "多智能体"), "https://arxiv.org/abs/2307.07924", "Communicative Agents for Software Development", 900),
    (("semantic communication", "语义压缩", "semantic compression"), "https://arxiv.org/abs/2201.01389", "Semantic Communications: Principles and Challenges", 880),
)
MIN_SCORE = 750
SCORES = ("relevance", "support", "coverage")


def first_set(*names: str) -> Column:
    """The first of a row's columns that is neither null nor empty; empty if none is."""
    return F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names), F.lit(""))


def accumulate(hits: DataFrame, contexts: DataFrame) -> DataFrame:
    """query_id, place, evidence_id, title, content, citation: the hits(query_id, list, pos, result_type, chunk_id, node_id,
    edge_id, paper_id, item_id, paper_title, title, name, description, content, snippet, citation) of a query, each piece
    once in order; a query without hits gets its context text (query_id, context) as the one piece."""
    piece = F.concat(F.coalesce(F.nullif("result_type", F.lit("")), F.lit("document")), F.lit(":"), first_set("chunk_id", "node_id", "edge_id", "paper_id", "item_id"))
    title = F.coalesce(F.nullif(first_set("paper_title", "title", "name", "description"), F.lit("")), F.lit("证据"))
    rows = hits.select("query_id", "list", "pos", piece.alias("evidence_id"), title.alias("title"), F.coalesce(F.nullif(first_set("content", "description", "snippet"), F.lit("")), title).alias("content"), F.coalesce(F.nullif("citation", F.lit("")), piece).alias("citation"))
    once = evidence.first_of(rows, ["query_id", "evidence_id"], "list", "pos")
    out = once.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("list", "pos")).alias("place"), "evidence_id", "title", "content", "citation")
    alone = contexts.where("context <> ''").join(out.select("query_id").distinct(), "query_id", "left_anti")
    return out.unionByName(alone.select("query_id", F.lit(1).alias("place"), F.lit("context:1").alias("evidence_id"), F.lit("检索上下文").alias("title"), F.col("context").alias("content"), F.lit("context:1").alias("citation")))


def evidence_text(pieces: DataFrame, most: int = 8, chars: int = 700) -> DataFrame:
    """query_id, text: the first pieces of evidence as `[id] title: content` lines."""
    line = F.concat(F.lit("["), "evidence_id", F.lit("] "), "title", F.lit(": "), F.substring("content", 1, chars))
    return _lines(pieces.where(F.col("place") <= most).select("query_id", "place", line.alias("line")), "text")


def _lines(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias(name))


def sources(hits: DataFrame, preferred: DataFrame, external: DataFrame, stored: DataFrame, most: int = 8, most_all: int = 10, newest: int = 5) -> DataFrame:
    """query_id, place, source_id, name, kind of each of preferred(query_id, preferred): its hits(query_id, rank, result_type,
    item_id, name, chunk_type), those of preferred types first, each once, `most` of them; behind them the external
    results(query_id, rank, item_id, name); a query without either gets the newest stored chunks(chunk_id, name,
    chunk_type) of a preferred type, any if it prefers none."""
    liked = lambda: F.array_contains("preferred", F.coalesce("chunk_type", F.lit("")))
    own = hits.join(preferred, "query_id").withColumn("o", F.when(liked(), 0).otherwise(1)).withColumn("source_id", F.concat("result_type", F.lit(":"), "item_id"))
    own = evidence.first_of(own, ["query_id", "source_id"], "o", "rank").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "rank"))).where(F.col("n") <= most)
    rows = own.select("query_id", F.lit(0).alias("list"), "n", "source_id", "name", F.col("result_type").alias("kind"))
    ext = external.where(F.col("rank") <= most).select("query_id", F.lit(1).alias("list"), F.col("rank").alias("n"), F.concat(F.lit("web_evidence:"), "item_id").alias("source_id"), "name", F.lit("web_evidence").alias("kind"))
    rows = rows.unionByName(ext)
    rest = preferred.join(rows.select("query_id").distinct(), "query_id", "left_anti")
    # The newest of each type are enough for any preference, so only those meet the queries.
    latest = stored.withColumn("t", F.row_number().over(Window.partitionBy("chunk_type").orderBy(F.desc("chunk_id")))).where(F.col("t") <= newest)
    wanted = rest.withColumn("kind", F.explode(F.when(F.size("preferred") > 0, F.col("preferred")).otherwise(F.array(F.lit("*")))))
    some = wanted.where("kind <> '*'").join(latest.withColumnRenamed("chunk_type", "kind"), "kind").unionByName(wanted.where("kind = '*'").join(latest.withColumn("kind", F.lit("*")).drop("chunk_type"), "kind"))
    some = some.select("query_id", "chunk_id", "name").distinct().withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("chunk_id")))).where(F.col("n") <= newest)
    rows = rows.unionByName(some.select("query_id", F.lit(2).alias("list"), "n", F.concat(F.lit("chunk:"), "chunk_id").alias("source_id"), "name", F.lit("chunk").alias("kind")))
    once = evidence.first_of(rows, ["query_id", "source_id"], "list", "n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("list", "n"))).where(F.col("place") <= most_all).select("query_id", "place", "source_id", "name", "kind")


def paper_context(tasks: DataFrame, hits: DataFrame, links: DataFrame, chars: int = 520, links_most: int = 4) -> DataFrame:
    """query_id, context of tasks(query_id, text, task, preferred): the question, the task and its evidence, chunks of
    preferred types first and as many as the task wants, and the first links(query_id, rank, name)."""
    table = F.create_map(*(F.lit(x) for kv in CONTEXT_LINES.items() for x in kv))
    most = F.coalesce(F.try_element_at(table, F.col("task")), F.lit(6))
    chunks = evidence.first_of(hits.where("result_type = 'chunk'"), ["query_id", "item_id"], "rank").join(tasks.select("query_id", "preferred", most.alias("most")), "query_id")
    order = F.when(F.array_contains("preferred", F.coalesce("chunk_type", F.lit(""))), 0).otherwise(1)
    chunks = chunks.withColumn("o", order).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "rank"))).where(F.col("place") <= F.col("most"))
    line = F.concat(F.lit("- "), F.coalesce(F.nullif("title", F.lit("")), F.lit("未命名论文")), F.lit(" ["), F.coalesce(F.nullif("chunk_type", F.lit("")), F.lit("chunk")), F.lit(" "), F.coalesce("section_path", F.lit("")), F.lit("]: "), F.substring("content", 1, chars))
    body = _lines(chunks.select("query_id", "place", line.alias("line")), "body")
    near = _lines(links.where(F.col("rank") <= links_most).select("query_id", F.col("rank").alias("place"), F.concat(F.lit("- "), "name").alias("line")), "near")
    head = F.concat_ws("\n", F.concat(F.lit("【用户问题】"), "text"), F.concat(F.lit("【论文任务】"), "task"), F.lit("【论文证据】"))
    rows = tasks.join(body, "query_id").join(near, "query_id", "left")
    return rows.select("query_id", F.concat_ws("\n", head, "body", F.concat(F.lit("【关系证据】\n"), "near")).alias("context"))


def paper_grade(rows: DataFrame, round_no: int = 1) -> DataFrame:
    """query_id, relevance, support, coverage (millionths), sufficient, action, missing of rows(query_id, text, task, available,
    n_hits, and the plain grade's relevance, support, coverage, sufficient, action): a task whose chunk types are all there
    is sufficient, one that lacks some is not."""
    table = F.create_map(*(x for t, kinds in REQUIRED.items() for x in (F.lit(t), F.array(*(F.lit(k) for k in kinds)))))
    none = F.array().cast("array<string>")
    missing = F.array_except(F.coalesce(F.try_element_at(table, F.col("task")), none), "available")
    fresh = tx.contains_any(F.lower("text"), PAPER_FRESH)
    some = (F.size("available") > 0) | (F.col("n_hits") > 0)
    lacks = F.size(missing) > 0
    covered = ~lacks & some & ~fresh
    at = lambda c, full, low, high: F.when(covered, full).when(lacks, F.least(F.col(c), F.lit(low))).when(some, F.greatest(F.col(c), F.lit(high))).otherwise(F.col(c)).alias(c)
    enough = F.when(covered, True).when(lacks, False).otherwise(F.col("sufficient"))
    action = F.when(covered, "answer").when(lacks, F.when(F.lit(round_no >= 2) & fresh, "web_verify").otherwise("adjust_strategy")).otherwise(F.col("action"))
    full = 1_000_000
    return rows.select("query_id", at("relevance", 820_000, full, 750_000), at("support", 780_000, 660_000, 720_000), at("coverage", 780_000, 620_000, 720_000), enough.alias("sufficient"), action.alias("action"), F.array_join(missing, ",").alias("missing"))


def merge_grade(rules: DataFrame, proposed: DataFrame) -> DataFrame:
    """A proposed grade p_* (strings, as a model returns them) over the rules' one: scores are clamped to 0..1, what can't be
    read or isn't a known action is left, and a sufficient grade answers."""
    rows = rules.join(proposed, "query_id", "left")

    def score(c: str) -> Column:
        read = F.expr(f"try_cast(p_{c} AS DOUBLE)")
        return F.when(read.isNotNull(), F.least(F.greatest(tx.scaled(read), F.lit(0)), F.lit(1_000_000))).otherwise(F.col(c)).alias(c)

    enough = F.coalesce(F.expr("try_cast(p_sufficient AS BOOLEAN)"), F.col("sufficient"))
    action = F.when(enough, "answer").when(F.col("p_action").isin(*ACTIONS), F.col("p_action")).otherwise(F.col("action"))
    return rows.select("query_id", *map(score, SCORES), enough.alias("sufficient"), action.alias("action"))


def asks_for_more(rows: DataFrame) -> DataFrame:
    """query_id, prompt: whether an answer to rows(query_id, text, sufficient, coverage, context) should offer to look outside:
    the question wants external evidence, didn't ask for the web, and what there is is thin."""
    low = F.lower(F.coalesce("text", F.lit("")))
    thin = ~F.col("sufficient") | (F.col("coverage") < 650_000) | (F.length(F.coalesce("context", F.lit(""))) < 400)
    return rows.select("query_id", (~tx.contains_any(low, ASKS_WEB) & tx.contains_any(low, EXTERNAL) & thin).alias("prompt"))


def citation_lines(rows: DataFrame, most: int = 8) -> DataFrame:
    """query_id, context, links of external results(query_id, rank, title, url, authors, year, source, paper_id, provider,
    snippet): `- [n] title [meta]: snippet (url)` lines, and the list of links of those that have one."""
    kept = rows.where(F.col("rank") <= most)
    label = F.concat(F.lit("["), "rank", F.lit("]"))
    filled = lambda c, prefix="": F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(prefix), F.col(c).cast("string")))
    meta = F.concat_ws(" | ", filled("authors"), filled("year"), filled("source"), filled("paper_id", "paper_id="), filled("provider", "provider="))
    line = F.concat(F.lit("- "), label, F.lit(" "), "title", F.when(meta != "", F.concat(F.lit(" ["), meta, F.lit("]"))).otherwise(""), F.lit(": "), "snippet", F.lit(" ("), "url", F.lit(")"))
    link = F.concat(F.lit("- "), label, F.lit(" "), F.coalesce(F.nullif("title", F.lit("")), F.lit("外部论文")), F.lit(". "), F.coalesce(F.nullif("authors", F.lit("")), F.lit("作者未知")), F.lit(". "), F.coalesce(filled("year"), F.lit("年份未知")), F.lit(". "), "url")
    a = _lines(kept.select("query_id", F.col("rank").alias("place"), line.alias("line")), "context")
    b = _lines(kept.where("url <> ''").select("query_id", F.col("rank").alias("place"), link.alias("line")), "links")
    return a.join(b, "query_id", "left").select("query_id", "context", F.coalesce("links", F.lit("")).alias("links"))


def description() -> Column:
    """`authors. year. source. snippet` of a row, without what is empty."""
    parts = F.concat_ws(". ", *(F.nullif(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("")) for c in ("authors", "year", "source")))
    return F.regexp_replace(F.concat(parts, F.lit(". "), F.coalesce("snippet", F.lit(""))), "^[. ]+|[. ]+$", "")


def known_results(queries: DataFrame) -> DataFrame:
    """query_id, url, title, quality (thousandths): results that a query's words stand for, whatever a search finds."""
    low = F.lower(F.coalesce("text", F.lit("")))
    found = F.array_compact(F.array(*(F.when(tx.contains_any(low, words), F.struct(F.lit(url).alias("url"), F.lit(title).alias("title"), F.lit(q).alias("quality"))) for words, url, title, q in KNOWN)))
    return queries.select("query_id", F.explode(found).alias("k")).select("query_id", "k.*")


def accept(candidates: DataFrame, graded: DataFrame, min_score: int = MIN_SCORE, most: int = 3) -> DataFrame:
    """query_id, index, score (thousandths): candidates(query_id, index, quality, rank) that a model's grades(query_id, index,
    score) accept; a query for which it accepts none gets its `most` best by quality, scored min_score at least."""
    by_model = graded.where(F.col("score") >= min_score).join(candidates.select("query_id", "index"), ["query_id", "index"]).select("query_id", "index", "score")
    rest = candidates.join(by_model.select("query_id").distinct(), "query_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("quality"), "rank", "index"))
    ruled = rest.withColumn("n", place).where(F.col("n") <= most).select("query_id", "index", F.greatest(F.col("quality"), F.lit(min_score)).alias("score"))
    return by_model.unionByName(ruled)


def external_evidence(academic: DataFrame, rewritten: DataFrame, web: DataFrame, asked: DataFrame, most: int = 8) -> DataFrame:
    """query_id, place, key: the external evidence of asked(query_id, needs_academic, needs_web): academic results first; with
    under three, those of the rewritten query behind them; the web's only if it is asked for or there is nothing else."""
    paper = academic.join(asked.where("needs_academic").select("query_id"), "query_id", "left_semi")
    few = asked.where("needs_academic").join(paper.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < 3).select("query_id")
    more = rewritten.join(few, "query_id", "left_semi")
    found = paper.select("query_id", "rank", "key", F.lit(0).alias("list")).unionByName(more.select("query_id", "rank", "key", F.lit(1).alias("list")))
    none = asked.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    wanted = asked.where("needs_web or not needs_academic").select("query_id").unionByName(none).distinct()
    rows = found.unionByName(web.join(wanted, "query_id", "left_semi").select("query_id", "rank", "key", F.lit(2).alias("list"))).where("key <> ''")
    once = evidence.first_of(rows.withColumn("key", F.lower("key")), ["query_id", "key"], "list", "rank")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("list", "rank"))).where(F.col("place") <= most).select("query_id", "place", "key")
