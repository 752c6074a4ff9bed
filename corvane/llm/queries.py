"""Queries of this package: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from corvane.llm import chat_format, url_filters
from corvane.llm.chat_format import op3_chat_format
from corvane.llm.decontamination import op1_decontamination
from corvane.llm.near_dedup import op7_near_dedup
from corvane.llm.packing import op6_best_fit_packing
from corvane.llm.quality_classifier import op4_quality_classifier
from corvane.llm.quality_rules import op10_quality_rules
from corvane.llm.suffix_dedup import op9_suffix_dedup
from corvane.llm.token_counts import op8_token_counts
from corvane.llm.token_files import op2_token_files
from corvane.llm.url_filters import op5_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_token_files, op3_chat_format, op4_quality_classifier, op5_url_filters,
        op6_best_fit_packing, op7_near_dedup, op8_token_counts, op9_suffix_dedup, op10_quality_rules,
    )
}

#: DuckDB SQL of those that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {"op3_chat_format": chat_format.ORACLE, "op5_url_filters": url_filters.ORACLE}
