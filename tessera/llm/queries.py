"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard_join, language_id, license_scans, media, mixing, oracles, packing, quality_rules, secret_scans, substring_dedup, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media_columns": media.op1_media_columns,
        "op2_mixing": mixing.op2_mixing,
        "op3_license_scans": license_scans.op3_license_scans,
        "op4_packing": packing.op4_packing,
        "op5_secret_scans": secret_scans.op5_secret_scans,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_language_id": language_id.op7_language_id,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_quality_rules": quality_rules.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_dedup": oracles.SUBSTRINGS, "op9_jaccard_join": oracles.JACCARD}
