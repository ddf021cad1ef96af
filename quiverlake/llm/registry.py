"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, language, pieces, pii, pipeline, pitman_yor, quality_ranker, quality_rules, simhash, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline.run,
        "op1_decontamination": decontamination.query,
        "op2_quality_ranker": quality_ranker.query,
        "op3_pitman_yor": pitman_yor.query,
        "op4_toxicity": toxicity.query,
        "op5_quality_rules": quality_rules.query,
        "op6_pieces": pieces.query,
        "op7_suffix_dedup": suffix_dedup.query,
        "op8_simhash": simhash.query,
        "op9_language": language.query,
        "op10_pii": pii.query,
    }


def oracle_sql() -> dict[str, str]:
    return {}
