"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, lines, packing, privacy, quality, secrets, simhash, simple8b, suffixdedup
from .common import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op1(spark, table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.op2(spark, table(spark, sf_dir, "documents"))


def op3_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.op3(spark, table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op4(spark, table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.op5(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op6(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(spark, table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op8(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op9(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op10(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_codes, op2_suffix_dedup, op3_private_terms, op4_secret_scan, op5_token_files, op6_line_dedup, op7_quality_rules, op8_packing, op9_decontamination, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": lines.SQL, "op9_decontamination": decontam.SQL}
