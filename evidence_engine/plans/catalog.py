"""The engine's queries over the test tables and their DuckDB twins, and the examples on literal rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidence_engine.plans import documents, evidence, graphs, hybrid, papers, policies, routing, search, service

_PARTS = (search, hybrid, graphs, routing, evidence, documents, policies, papers, service)
#: Examples whose inputs are rows in the code. They are checked in tests/test_examples.py and aren't queries, as their work
#: doesn't grow with the tables.
EXAMPLES = frozenset(
    "template_seed paper_graph_search paper_document_graph paper_seed_expansion paper_query_test web_usable academic_rank academic_relevance paper_verify arxiv_import_candidates reference_split"
    " paper_citations heading_similarity repeated_lines section_tree summary_lock topic_extract topic_reference toc_headings toc_match pdf_lines pdf_parse_scores pdf_good_enough"
    " pdf_layout_decision section_scores reference_fields academic_normalise academic_union academic_resolve academic_execute academic_query_words edges_delete nodes_of_document reply_json"
    " memory_store evidence_accumulate evidence_text answer_sources paper_context paper_grade grade_merge web_supplement citation_labels web_accept external_evidence research_workflow"
    " workflow_handoff state_graph_limits workflow_registry stage_attempt memory_first workflow_result ingest file_tables paper_titles layout_text noise_labels".split()
)


def _all(kind: str) -> dict:
    return {name: x for part in _PARTS for name, x in getattr(part, kind).items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in _all("QUERIES").items() if name not in EXAMPLES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in _all("ORACLES").items() if name not in EXAMPLES}


def examples() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """name -> (query, its DuckDB twin) of the examples on literal rows."""
    sql = _all("ORACLES")
    return {name: (f, sql.get(name)) for name, f in _all("QUERIES").items() if name in EXAMPLES}
