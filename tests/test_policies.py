"""Policies, layout and topics with values worked out by hand."""

from evidence_engine.plans import documents, policies


def rows(df, *keys):
    return {tuple(r[k] for k in keys) for r in df.collect()}


def test_layout(spark):
    got = [(r.text, r.heading) for r in policies.layout_text(spark, "").orderBy("doc_id", "line").collect()]
    assert got == [
        ("1 Notes on scope", True), ("Body text about scope that runs on for a while", False), ("more of it on scope, with a comma", False), ("RELATED SCOPE", True),
        ("2 Notes on design", True), ("Body text about design that runs on for a while", False), ("more of it on design, with a comma", False), ("RELATED DESIGN", True),
        ("3 Notes on limits", True), ("Body text about limits that runs on for a while", False), ("more of it on limits, with a comma", False), ("摘要", True),
    ]


def test_gates(spark, sf):
    own = lambda query: query(spark, sf).where("query_id < 100")  # noqa: E731  (ids of the literal rows)
    gate = {r.query_id: r.ask for r in own(policies.model_gate).collect()}
    assert (gate[1], gate[9], gate[7], gate[13]) == (False, False, True, True)
    over = {r.query_id: r for r in own(policies.plan_override).collect()}
    assert (over[4].bm25_top_k, over[4].vector_top_k, over[4].graph_depth, over[4].graph_method, over[4].intent, over[4].preferred) == (20, 10, 1, "path", "explain", "table,method")
    assert (over[9].bm25_top_k, over[9].graph_method) == (3, "ego")
    assert rows(own(policies.next_step), "query_id", "next") == {(1, "external_search"), (2, "external_search"), (3, "paper_analysis"), (4, "external_search"), (5, "observation"), (6, "observation")}
    assert rows(own(policies.answer_verify), "query_id", "supported") == {(1, True), (2, False), (3, False), (4, True)}
    assert rows(own(policies.related_papers), "query_id", "paper_id") == {(1, "p1"), (1, "p3"), (1, "p4"), (2, "p2"), (2, "s2"), (2, "s3")}


def test_topics(spark):
    assert rows(documents.topic_extract(spark, ""), "label", "turn", "content") == {("1", 1, "方向一：检索增强\n细节 A"), ("2", 1, "方向2 图谱\n细节 B"), ("1", 3, "### 方向一：检索增强\n更长的细节 A 与数据")}
    assert rows(documents.topic_reference(spark, ""), "query_id", "content") == {(2, "### 方向一：检索增强\n更长的细节 A 与数据")}


def test_headers_survive_the_round_trip(spark, sf):
    got = {(r.doc_id, r.chunk_type): r for r in policies.chunk_headers(spark, sf).collect()}
    assert got[1, "method"].method_name == "M" and got[1, "table"].paper_title == "T" and got[1, "code"].metric == ""
