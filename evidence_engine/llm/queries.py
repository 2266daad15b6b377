"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidence_engine.llm import oracles
from evidence_engine.llm.code_compression import op13_code_compression
from evidence_engine.llm.decontaminate import op6_decontaminate
from evidence_engine.llm.divergence import op11_divergence
from evidence_engine.llm.html_extract import op5_html_extract
from evidence_engine.llm.language_id import op1_language_id
from evidence_engine.llm.packing import op7_packing
from evidence_engine.llm.secret_scan import op8_secret_scan
from evidence_engine.llm.simhash import op4_simhash
from evidence_engine.llm.substring_dedup import op3_substring_dedup
from evidence_engine.llm.token_counts import op10_token_counts
from evidence_engine.llm.topk_search import op9_topk_search
from evidence_engine.llm.toxicity import op12_toxicity
from evidence_engine.llm.url_rules import op2_url_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_url_rules": op2_url_rules,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_simhash": op4_simhash,
        "op5_html_extract": op5_html_extract,
        "op6_decontaminate": op6_decontaminate,
        "op7_packing": op7_packing,
        "op8_secret_scan": op8_secret_scan,
        "op9_topk_search": op9_topk_search,
        "op10_token_counts": op10_token_counts,
        "op11_divergence": op11_divergence,
        "op12_toxicity": op12_toxicity,
        "op13_code_compression": op13_code_compression,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_rules": oracles.URL_RULES,
        "op3_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op9_topk_search": oracles.TOPK_SEARCH,
        "op11_divergence": oracles.DIVERGENCE,
        "op13_code_compression": oracles.CODE_COMPRESSION,
    }
