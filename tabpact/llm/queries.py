"""The registered queries of the operators for training data, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import block_labeller, decontamination, language, lengths, licences, line_dedup, line_quality, lm_scoring, manifest, pieces, quality_classifier, resampling, simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_quality": line_quality.op1_line_quality,
        "op2_language": language.op2_language,
        "op3_lm_scoring": lm_scoring.op3_lm_scoring,
        "op4_lengths": lengths.op4_lengths,
        "op5_main_text": block_labeller.op5_main_text,
        "op6_licences": licences.op6_licences,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_simhash": simhash.op8_simhash,
        "op9_pieces": pieces.op9_pieces,
        "op10_decontamination": decontamination.op10_decontamination,
        "op11_quality": quality_classifier.op11_quality,
        "op12_resampling": resampling.op12_resampling,
        "op13_manifest": manifest.op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_quality": line_quality.OP1_SQL,
        "op6_licences": licences.OP6_SQL,
        "op7_line_dedup": line_dedup.OP7_SQL,
        "op12_resampling": resampling.OP12_SQL,
        "op13_manifest": manifest.OP13_SQL,
    }
