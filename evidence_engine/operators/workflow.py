"""Workflows over batches: a runner of state graphs, registries of stages, and the research workflow's steps.

A batch of runs is a DataFrame with a column `node`; each step moves every run along the first edge whose condition holds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_engine.functions import text as tx
from evidence_engine.operators import policies
from evidence_engine.operators import routing as r
from evidence_engine.sources.scratch import kept

Stage = Callable[[DataFrame], DataFrame]
Edge = tuple[str, str, Column | None]
_TRACE = "array<string>"


def run_graph(states: DataFrame, nodes: Mapping[str, Stage], edges: Sequence[Edge], start: str, max_steps: int = 16) -> DataFrame:
    """states with the columns trace (nodes in order) and error after each run has gone from `start` along the edges until no
    edge holds; a run that is still going after max_steps, or comes to a node that isn't there, gets an error.

    A node's stage sees all runs that stand at it at once, and returns them with the same columns; the runs' columns are
    what conditions are asked of. The driver loops over steps and nodes only.
    """
    now = states.withColumns({"node": F.lit(start), "trace": F.array().cast(_TRACE), "error": F.lit("")})
    done = None
    for _ in range(max_steps):
        here = [x[0] for x in now.select("node").distinct().collect()]  # at most one for each node
        moved = None
        for name in sorted(here):
            mine = now.where(F.col("node") == name)
            if name in nodes:
                after = nodes[name](mine).withColumn("trace", F.array_append("trace", F.lit(name)))
                to = F.lit(None).cast("string")
                for src, dst, cond in reversed([e for e in edges if e[0] == name]):
                    to = F.lit(dst) if cond is None else F.when(F.coalesce(cond, F.lit(False)), F.lit(dst)).otherwise(to)
            else:
                after, to = mine.withColumn("error", F.lit(f"missing node: {name}")), F.lit(None).cast("string")
            after = after.withColumn("node", to).select(*now.columns)
            moved = after if moved is None else moved.unionByName(after)
        moved = kept(moved, "graph-states")
        ended = moved.where("node is null")
        done = ended if done is None else done.unionByName(ended)
        now = moved.where("node is not null")
        if now.isEmpty():
            break
    else:
        done = done.unionByName(now.withColumn("error", F.lit("exceeded max steps")))
    return done.drop("node")


class Registry:
    """Stages by name; a name that isn't known stands for the default."""

    def __init__(self, default: str):
        self.default, self.stages = default, {}

    def register(self, name: str, stage: Stage) -> None:
        self.stages[name] = stage

    def get(self, name: str) -> Stage:
        return self.stages.get(name, self.stages[self.default])

    def run(self, rows: DataFrame, path: str = "path") -> DataFrame:
        """rows(…, path) each through its path's stage, with the name of the stage that it went through as `ran`."""
        names = list(self.stages)
        ran = F.when(F.col(path).isin(*names), F.col(path)).otherwise(self.default)
        rows, out = rows.withColumn("ran", ran), None
        for name in names:
            part = self.stages[name](rows.where(F.col("ran") == name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out


def attempt(stage: Stage, rows: DataFrame) -> tuple[bool, DataFrame | None, str]:
    """(success, result, message) of a stage; an error becomes a failed result. The stage is run, not only planned."""
    try:
        return True, kept(stage(rows), "stage-result"), ""
    except Exception as error:  # whatever the stage raises is its result
        return False, None, f"{type(error).__name__}: {error}"


# What a paper task's expert answers by; the default is the overview's.
EXPERTS = {"overview": "paper_overview_expert", "method": "paper_method_expert", "experiment": "paper_experiment_expert", "compare": "paper_compare_expert", "literature_review": "paper_literature_review_expert", "opening_report": "paper_opening_report_expert", "outline": "paper_outline_expert"}


def expert_of(task: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in EXPERTS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, task), F.lit(EXPERTS["overview"]))


# The research workflow.

#: What may follow what.
TOOL_GRAPH = {
    "memory_guard": ("memory_first_answer", "planner"), "memory_first_answer": ("finalize",), "planner": ("decompose", "finalize"), "decompose": ("action_policy",), "action_policy": ("local_search", "external_search", "paper_analysis", "observation"),
    "local_search": ("external_search", "paper_analysis", "observation"), "external_search": ("paper_analysis", "observation"), "paper_analysis": ("observation",), "observation": ("synthesis",), "synthesis": ("citation_verifier",),
    "citation_verifier": ("targeted_repair", "finalize"), "targeted_repair": ("synthesis", "finalize"), "finalize": (),
}
MOST_WEB, MOST_ANALYSES = 1, 1
RESEARCH_WEB = ("联网", "搜索", "查找", "参考论文", "相关论文", "相关文献", "web search", "search")


def memory_first(queries: DataFrame) -> DataFrame:
    """query_id, memory_first: whether queries(query_id, text, memory, follows) are answered from memory: there is some, the web
    isn't asked for, and the query follows up or points back."""
    text = F.coalesce("text", F.lit(""))
    back = F.coalesce("follows", F.lit(False)) | tx.contains_any(text, r.MEMORY_FIRST)
    return queries.select("query_id", ((F.coalesce("memory", F.lit("")) != "") & ~tx.contains_any(F.lower(text), RESEARCH_WEB) & back).alias("memory_first"))


def research_start(queries: DataFrame) -> DataFrame:
    """The runs of queries(query_id, text, local, external, analysed, unsupported, repaired): how many pieces of evidence each
    search would give, and how many claims stay unsupported."""
    return queries.withColumns({"intent": F.lit(""), "actions": F.array().cast("array<string>"), "log": F.array().cast("array<string>"), "n_evidence": F.lit(0), "next": F.lit(""), "tried": F.lit(False)})


def _log(rows: DataFrame, action: Column | str, to: Column | str) -> DataFrame:
    """rows with an action recorded as `action>next`."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.withColumn("log", F.array_append("log", F.concat(as_col(action), F.lit(">"), as_col(to)))).withColumn("next", as_col(to))


def _thin() -> Column:
    fresh = tx.contains_any(F.lower("text"), ("最新", "当前", "近期", "现在", "趋势", "现状", "研究空白", "政策", "公告", "报告", "github", "benchmark", "paper", "论文", "2025", "2026", "近年"))
    return F.col("intent").isin("literature_review", "gap_analysis", "proposal_design") & ((F.col("n_evidence") == 0) | (fresh & (F.col("n_evidence") < 3)))


def research_nodes() -> dict[str, Stage]:
    """The workflow's stages: each fills the run's state and records one action."""
    has = lambda a: F.array_contains("actions", a)
    after_web = lambda: F.when(has("analyze_single_paper"), "paper_analysis").otherwise("observation")

    def planner(rows: DataFrame) -> DataFrame:
        judged = rows.drop("intent").join(r.research_intent(rows), "query_id")
        research = F.col("intent") != "not_research"
        return _log(judged, F.when(research, "decompose_question").otherwise("boundary_handoff"), F.when(research, "decompose").otherwise("finalize"))

    def decompose(rows: DataFrame) -> DataFrame:
        return _log(rows.drop("actions").join(policies.planned_actions(rows), "query_id"), "decompose_question", "action_policy")

    def action_policy(rows: DataFrame) -> DataFrame:
        to = F.when(has("search_local_papers") | has("search_local_knowledge"), "local_search").when(has("search_academic_or_web"), "external_search").when(has("analyze_single_paper"), "paper_analysis").otherwise("observation")
        return _log(rows, F.when(to == "observation", "skip_optional_tools").otherwise("decompose_question"), to)

    def local_search(rows: DataFrame) -> DataFrame:
        found = rows.withColumn("n_evidence", F.col("n_evidence") + F.col("local"))
        papers = F.col("intent").isin(*policies.LOCAL_PAPERS) | tx.contains_any(F.col("text"), ("论文", "文献"))
        to = F.when(has("search_academic_or_web") | _thin(), "external_search").otherwise(after_web())
        return _log(found, F.when(papers, "search_local_papers").otherwise("search_local_knowledge"), to)

    def external_search(rows: DataFrame) -> DataFrame:
        due = has("search_academic_or_web") | _thin()
        action = F.when(due, "search_academic_or_web").otherwise("skip_optional_tools")
        return _log(rows, action, after_web()).withColumn("n_evidence", F.col("n_evidence") + F.when(due, F.col("external")).otherwise(0))

    def paper_analysis(rows: DataFrame) -> DataFrame:
        return _log(rows.withColumn("n_evidence", F.col("n_evidence") + F.col("analysed")), "analyze_single_paper", "observation")

    def verifier(rows: DataFrame) -> DataFrame:
        repair = ~F.col("tried") & (F.col("n_evidence") > 0) & (F.col("unsupported") > 0)
        return _log(rows, "verify_claims", F.when(repair, "targeted_repair").otherwise("finalize"))

    def targeted_repair(rows: DataFrame) -> DataFrame:
        return _log(rows, "targeted_repair_search", F.when(F.col("repaired") > 0, "synthesis").otherwise("finalize")).withColumns({"tried": F.lit(True), "n_evidence": F.col("n_evidence") + F.col("repaired")})

    return {
        "memory_guard": lambda rows: _log(rows, "classify_research_intent", "planner"), "planner": planner, "decompose": decompose, "action_policy": action_policy, "local_search": local_search, "external_search": external_search,
        "paper_analysis": paper_analysis, "observation": lambda rows: _log(rows, "synthesize_research", "synthesis"), "synthesis": lambda rows: rows.withColumn("next", F.lit("citation_verifier")), "citation_verifier": verifier,
        "targeted_repair": targeted_repair, "finalize": lambda rows: rows.withColumn("next", F.lit("")),
    }


def research(queries: DataFrame) -> DataFrame:
    """query_id, intent, trace, log, n_evidence, error: the research workflow of a batch of queries, see research_start."""
    edges: list[Edge] = [(src, dst, F.col("next") == dst) for src, targets in TOOL_GRAPH.items() for dst in targets]
    out = run_graph(research_start(queries), research_nodes(), edges, "memory_guard")
    return out.select("query_id", "intent", F.array_join("trace", ",").alias("trace"), F.array_join("log", ",").alias("log"), "n_evidence", "error")


def handoff(queries: DataFrame) -> DataFrame:
    """query_id, path: where a query that isn't research goes: to the paper assistant, to verification, or to the plain paths."""
    low = F.lower("text")
    single = tx.contains_any(low, r.SINGLE_PAPER) & tx.contains_any(low, r.READING) & ~tx.contains_any(low, r.READING_NOT)
    verify = tx.contains_any(low, r.PURE_VERIFY) & ~tx.contains_any(low, r.PURE_VERIFY_NOT)
    return queries.select("query_id", F.when(single, "paper_assistant").when(verify, "self_rag").otherwise("fast").alias("path"))


def assemble(answers: DataFrame, pieces: DataFrame, claims: DataFrame, checks: DataFrame) -> DataFrame:
    """One record a run: query_id, path, response, success, confidence, n_evidence, n_claims, supported of answers(query_id, path,
    response, confidence), evidence pieces(query_id), claims(query_id) and checks(query_id, supported)."""
    n = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    rows = answers.join(n(pieces, "n_evidence"), "query_id", "left").join(n(claims, "n_claims"), "query_id", "left").join(checks.select("query_id", "supported"), "query_id", "left")
    return rows.select("query_id", "path", "response", (~F.col("response").startswith("[错误]")).alias("success"), F.when(F.col("response").startswith("[错误]"), 0.0).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("supported", F.lit(False)).alias("supported"))
