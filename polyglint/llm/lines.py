r"""Corpus-wide line dedup: op6. DataFrame operations only.

A text is split at \n. A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
min_chars code points that occur in at least min_docs documents lose all their lines but those of the largest doc_id.

Only 16-byte digests of long keys are shuffled, each once a document, and counted with map-side combination; texts move
once, for reassembly. Hot keys never meet in one task: the MOST keys of the most documents are broadcast (40 bytes each),
and only the lines of rarer keys, if there are any, are shuffled to them. Null or empty text: one empty line. A null doc_id counts as one document, smaller than any other.
Rows that repeat a doc_id are one document for the count, and each keeps or drops its own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, inputs, lookup, saved

#: Keys that are broadcast at most.
MOST = 200_000


def digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def dropped_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """lines: doc_id, key. Keys in at least min_docs documents, their number, and the largest document that has each."""
    per_doc = lines.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    return per_doc.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, carry: tuple[str, ...] = (), most: int = MOST) -> DataFrame:
    """doc_id, kept (the remaining text), n_lines, n_dropped, and carried: a struct of the columns in carry."""
    texts = inputs(docs).withColumn("lines", F.split("text", "\n", -1))
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))

    def key(line: Column) -> Column:
        return F.btrim(line, F.lit(SPACE_CHARS))

    long = texts.select("doc_id", F.explode(F.array_distinct(F.filter("lines", lambda x: F.char_length(x) >= min_chars))).alias("line"))
    long = long.select("doc_id", key(F.col("line")).alias("line")).filter(F.char_length("line") >= min_chars)
    long = long.select("doc_id", digest(ascii_lower(F.col("line"))).alias("key"))
    long = saved(docs.sparkSession, long, "long-lines")
    frequent = saved(docs.sparkSession, dropped_keys(long, min_docs), "frequent-lines")
    gone = lookup(long, frequent, "key", "n_docs", most).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy("doc_id").agg(F.collect_set("key").alias("gone"))
    joined = whole.join(gone.withColumnRenamed("doc_id", "gone_id"), F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    # only documents that lose a line take their lines apart again
    lines = F.split("text", "\n", -1)
    left = F.filter(lines, lambda x: ~((F.char_length(x) >= min_chars) & F.array_contains(F.col("gone"), digest(ascii_lower(key(x))))))
    hit = F.col("gone").isNotNull()
    out = joined.withColumn("left", F.when(hit, left))
    return out.select(
        "doc_id",
        "carried",
        F.when(hit, F.array_join("left", "\n")).otherwise(F.col("text")).alias("kept"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(hit, (F.size(lines) - F.size("left")).cast("long")).otherwise(F.lit(0).cast("long")).alias("n_dropped"),
    )


def op6(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.line, k.pos, (f.key IS NOT NULL AND k.doc_id <> f.keeper) AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
