"""Literal inputs for operators whose branches the test tables don't reach: our own queries, turns, plans and papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = [
    (1, "hi"), (2, "你好呀"), (3, "ok 那就这样"), (4, "总结一下知识库的整体框架"), (5, "围绕检索模块总结上下游"), (6, "检索模块由什么组成"), (7, "向量检索和重排之间的关系"),
    (8, "索引结构如何导致延迟，二者的因果是什么"), (9, "BM25 scoring"), (10, "怎么优化召回"), (11, "什么是召回率"), (12, "这块的配合怎么设计"), (13, "今天天气不错呢"),
    (14, "这篇论文的实验指标有哪些"), (15, "这个结论是否可靠，依据是什么"), (16, "对比 GraphRAG 和 Self-RAG 的差异，给出技术路线设计方案"), (17, "帮我写一份开题报告，关注研究空白与多篇论文"),
    (18, "最新的 2026 current state"), (19, "给出论文大纲"), (20, "what is retrieval"), (21, "继续"), (22, "那它的方法呢"), (23, "刚才说的第二点怎么样"), (24, "联网查一下"),
    (25, "论文的贡献和创新点"), (26, "摘要讲了什么"), (27, "相关工作综述"), (28, "compare model A vs model B"), (29, "算法的代码如何实现"), (30, "这个研究方向可做吗"),
    (31, "explain the relationship between attention, memory and retrieval in long documents with many parts"), (32, ""), (33, "该论文的局限与不足 this paper 总结"), (34, "验证该说法并查证"), (35, "agent 记忆方法"),
]
ACADEMIC = [
    (1, "这篇论文真实存在吗 arXiv:2401.12345v2"), (2, "找 Attention 的相关论文"), (3, "谁引用了 1706.03762"), (4, "列出参考文献 DOI: 10.1000/xyz123"), (5, "推荐相似的工作 PMID: 123456"),
    (6, "论文中关于注意力的片段"), (7, "作者 Vaswani 的论文"), (8, "https://arxiv.org/abs/2005.11401"), (9, "标题 exact match of Dense Passage Retrieval"), (10, "dense retrieval for clinical LLM since 2021"),
    (11, "2018-2021 问答 综述"), (12, "2020年以后 的多模态检索"), (13, "retrieval || multi-agent rag for medical text。其他内容"), (14, "帮我搜索最新论文 about knowledge graph retrieval retrieval survey"),
    (15, "da39a3ee5e6b4b0d3255bfef95601890afd80709"), (16, "元数据 detail please"), (17, ""),
]
#: query_id, pos, role, content, path, intent.
TURNS = [
    (21, 1, "user", "比较两种方法", None, None), (21, 2, "assistant", "……", "pipeline", "complex_analysis"), (22, 1, "assistant", "……", "fast", "fact_qa"), (22, 2, "assistant", "……", "paper", None), (22, 3, "user", "那它的方法呢", None, None),
    (23, 1, "assistant", "……", "crag", "verify_or_freshness"), (24, 1, "assistant", "……", None, None), (24, 2, "assistant", "……", "research", "research_design"), (9, 1, "assistant", "……", "research", "x"),
]
FORCED = {10: "paper", 11: "nonsense", 12: "fast"}
#: plan_id, pos, id, type, depends_on.
PLANS = [
    (1, 1, "t1", "retrieve_papers", []), (1, 2, "t2", "summarize_evidence", ["t1", "t9"]), (1, 3, "t3", "verify_claims", ["t2"]),
    (2, 1, "a", "retrieve_papers", []), (2, 2, "b", "make_coffee", ["a"]),
    *[(3, k, f"r{k}", "retrieve_kg_context", []) for k in range(1, 7)],
    *[(4, k, f"s{k}", "summarize_evidence" if k != 3 else "verify_claims", [f"s{k - 1}"]) for k in range(1, 11)],
    (5, 1, "only", "compare_methods", ["nowhere"]),
]


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id int, text string")


def academic(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACADEMIC, "query_id int, text string")


def turns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TURNS, "query_id int, pos int, role string, content string, path string, intent string")


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan_id int, pos int, id string, type string, depends_on array<string>")


def forced(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FORCED.items()), "query_id int, force_path string")


def values_sql(rows: list[tuple], columns: str) -> str:
    """Rows as a DuckDB table expression."""

    def lit(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, list):
            return "CAST([" + ", ".join(map(lit, x)) + "] AS VARCHAR[])"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({columns}))"
