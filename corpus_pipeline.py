"""From raw documents to packed training sequences, in stages over whole tables.

Every stage takes any number of rows, none included; doc_id may be null or repeated (each row is judged for itself), text
may be null (empty), and columns besides those of documents are ignored and not passed on. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.llm import decontam, lines, nearcopies, packing, quality
from polyglint.llm.common import saved, table
from polyglint.llm.registry import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the posterior of the quality rules accepts."""
    return quality.good_rows(spark, docs, COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that the corpus repeats."""
    out = lines.dedup_lines(docs, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "carried.lang", "carried.source", F.char_length("kept").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash links, completed to five-word shingle sets of similarity 0.8) the document with
    the least doc_id; documents that share an id, or have none, go only for a near copy of their own."""
    return nearcopies.one_of_each(spark, docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontam.clean(spark, docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and the sequences that they make up. Executors that the stages before have grown have
    less room for workers: these take less text at a time than operator 8's."""
    return packing.op8(spark, docs, vocabulary("byte_bpe_50k.json"), chars=4_000_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Components of near copies and tokenisation are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *stages, last = STAGES
    for name, stage in stages:
        docs = saved(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return last[1](spark, docs, sf_dir)
