"""The registered corpus queries, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, language_id, near_dedup, neighbours, packing, quality_classifier, quality_rules, sentencepieces, sharding, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_sharding": sharding.op2_sharding,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_quality_classifier": quality_classifier.op4_quality_classifier,
        "op5_neighbours": neighbours.op5_neighbours,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_html_text": html_text.op7_html_text,
        "op8_warc": warc.op8_warc,
        "op9_sentencepiece": sentencepieces.op9_sentencepiece,
        "op10_quality_rules": quality_rules.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": sharding.ORACLE, "op8_warc": warc.ORACLE, "op10_quality_rules": quality_rules.ORACLE}
