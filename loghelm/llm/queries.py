"""The named queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loghelm.llm import decontaminate, exact_dedup, hard_negatives, html_text, language_model, lexical, mixing, near_duplicates, quality, secrets, sharding, substring_dedup, toxicity
from loghelm.llm.common import read


def _on(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(*[read(spark, folder, table) for table in tables])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": _on(toxicity.op1_toxicity, "documents", "labels"),
    "op2_decontaminate": _on(decontaminate.op2_decontaminate, "documents", "benchmark"),
    "op3_mix_sources": _on(mixing.op3_mix_sources, "documents"),
    "op4_substring_dedup": _on(substring_dedup.op4_substring_dedup, "documents"),
    "op5_exact_dedup": _on(exact_dedup.op5_exact_dedup, "documents"),
    "op6_near_duplicates": _on(near_duplicates.op6_near_duplicates, "documents"),
    "op7_html_text": _on(html_text.op7_html_text, "pages"),
    "op8_quality": _on(quality.op8_quality, "documents", "labels"),
    "op9_sharding": _on(sharding.op9_sharding, "documents"),
    "op10_secrets": _on(secrets.op10_secrets, "documents"),
    "op11_hard_negatives": _on(hard_negatives.op11_hard_negatives, "embeddings"),
    "op12_language_model": _on(language_model.op12_language_model, "documents"),
    "op13_lexical": _on(lexical.op13_lexical, "documents", "benchmark"),
}

ORACLES: dict[str, str] = {
    "op3_mix_sources": mixing.OP3_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op13_lexical": lexical.OP13_SQL,
}
