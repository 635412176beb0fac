"""Queries of the operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signalloom.llm.bpe import op9_bpe
from signalloom.llm.divergence import OP11_SQL, op11_source_divergence
from signalloom.llm.html import op8_html_extraction
from signalloom.llm.importance import op12_importance_resampling
from signalloom.llm.jaccard import op2_ngram_jaccard
from signalloom.llm.lines import OP6_SIZED_SQL, OP6_SQL, op6_line_dedup, op6_sized_line_dedup
from signalloom.llm.packing import op7_best_fit_packing
from signalloom.llm.quality import op3_quality_rules
from signalloom.llm.secrets import OP13_SQL, op13_secret_scan
from signalloom.llm.substrings import op4_substring_dedup
from signalloom.llm.suffixes import op5_suffix_dedup
from signalloom.llm.tokenfile import op1_token_files
from signalloom.llm.vectors import op10_embedding_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_quality_rules": op3_quality_rules,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op6_sized_line_dedup": op6_sized_line_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_html_extraction": op8_html_extraction,
    "op9_bpe": op9_bpe,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_secret_scan": op13_secret_scan,
}

ORACLES: dict[str, str] = {
    "op6_line_dedup": OP6_SQL,
    "op6_sized_line_dedup": OP6_SIZED_SQL,
    "op11_source_divergence": OP11_SQL,
    "op13_secret_scan": OP13_SQL,
}
