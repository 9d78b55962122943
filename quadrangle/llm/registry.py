"""The corpus queries and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP12_SQL, op12_collocations
from .decontaminate import op3_decontaminate
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .html_text import op4_html_text
from .prefix_trie import op13_prefix_trie
from .quality import op5_quality
from .secrets import op2_secret_spans
from .simhash_dedup import op1_simhash_dedup
from .source_mix import op6_source_mix
from .token_counts import op8_token_counts
from .token_output import op9_token_output
from .toxicity import op10_toxicity
from .weighted_sampling import op11_fingerprints

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_secret_spans": op2_secret_spans,
    "op3_decontaminate": op3_decontaminate,
    "op4_html_text": op4_html_text,
    "op5_quality": op5_quality,
    "op6_source_mix": op6_source_mix,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_token_output": op9_token_output,
    "op10_toxicity": op10_toxicity,
    "op11_fingerprints": op11_fingerprints,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}
_SQL: dict[str, str] = {"op7_exact_dedup": OP7_SQL, "op12_collocations": OP12_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
