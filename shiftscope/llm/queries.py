"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shiftscope.llm import bpe, chat_format, exact_dedup, html_text, license_scan, mixing, ngram_join, quality_rules, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": html_text.op1_html_extraction,
        "op2_mixing": mixing.op2_mixing,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_chat_formatting": chat_format.op6_chat_formatting,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_bpe": bpe.op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_chat_formatting": chat_format.OP6_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
    }
