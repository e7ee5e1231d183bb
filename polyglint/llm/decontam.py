r"""Benchmark decontamination as a prefix-filtered set join: op9. DataFrame operations only.

Words: A-Z lower-cased, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`. A window is 10 consecutive words of an item (an item of fewer:
all of them). To occur, a window's words must all occur, so its rarest word is a sufficient prefix: words are ordered
by how many documents hold them, a window with a word that no document holds can't occur at all, and each other window
is probed only where its rarest word stands. The word's offset in the window bounds the place and the length to compare;
the words around it are then compared exactly. A document word inside any occurrence is hit.

The corpus is never shuffled as text: what moves is a count per benchmark word, the places of rarest words with the
words around them, and ids. The benchmark is broadcast, and its rarest words used as a set in the plan, only while they
number MOST at most; beyond that the same steps run as shuffled joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, inputs, saved

SIZE = 10
MOST = 50_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """win (array of words), items (ids as strings): each distinct window once."""
    words = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), words_of(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item").alias("items"))


def probes(spark: SparkSession, texts: DataFrame, wins: DataFrame, most: int) -> tuple[DataFrame, int]:
    """anchor and, for each of its windows, back (words before the anchor), win and items; and the number of anchors."""
    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    small = vocabulary.count() <= most
    held = texts.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    counts = held.join(F.broadcast(vocabulary) if small else vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    counts = saved(spark, counts, "rarity")
    each = wins.select("win", "items", F.posexplode("win").alias("back", "word")).join(counts, "word", "left")
    rarest = each.groupBy("win").agg(F.first("items").alias("items"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "back")).alias("a"))
    out = rarest.filter("a.n > 0").groupBy(F.col("a.word").alias("anchor")).agg(F.collect_list(F.struct(F.col("a.back").alias("back"), "win", "items")).alias("probes"))
    out = saved(spark, out, "probes")
    return out, out.count()


def keyed(docs: DataFrame) -> DataFrame:
    return inputs(docs).select("doc_id", F.md5("text").alias("text_key"), "text")


def occurrences(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = SIZE, most: int = MOST) -> DataFrame:
    """doc_id, text_key, hits (array of start, 0-based, and length), items (sorted ids) for documents with any hit.

    Null or empty texts have no words; equal rows are one document; an empty benchmark hits nothing.
    """
    texts = keyed(docs)
    wins = saved(spark, windows(items, size=size), "windows")
    probe, n = probes(spark, texts, wins, most)
    words = texts.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
    if n <= most:
        anchors = [r[0] for r in probe.select("anchor").collect()]
        at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())
        placed = words.select("doc_id", "text_key", "words", at.alias("at"))
    else:
        places = words.select("doc_id", "text_key", F.posexplode("words").alias("i", "anchor")).join(probe.select("anchor"), "anchor")
        places = places.groupBy("doc_id", "text_key").agg(F.collect_set("i").alias("at"))
        placed = words.alias("w").join(places.alias("p"), F.expr("w.doc_id <=> p.doc_id AND w.text_key = p.text_key")).select("w.doc_id", "w.text_key", "words", "at")
    around = placed.filter(F.size("at") > 0).select(
        "doc_id",
        "text_key",
        F.explode(
            F.transform(
                "at",
                lambda i: F.struct(
                    i.alias("i"),
                    F.greatest(i - (size - 1), F.lit(0)).alias("low"),
                    F.slice("words", F.greatest(i - (size - 1), F.lit(0)) + 1, 2 * size - 1).alias("near"),
                    F.get("words", i).alias("anchor"),
                ),
            )
        ).alias("c"),
    )
    around = around.select("doc_id", "text_key", "c.*")
    joined = around.join(F.broadcast(probe) if n <= most else probe, "anchor")
    start = F.col("i") - F.col("low")
    found = F.filter("probes", lambda p: (p["back"] <= start) & (F.slice("near", F.greatest(start - p["back"], F.lit(0)) + 1, F.size(p["win"])) == p["win"]))
    matched = joined.select("doc_id", "text_key", "i", found.alias("found")).filter(F.size("found") > 0)
    spans = matched.select("doc_id", "text_key", F.transform("found", lambda p: F.struct((F.col("i") - p["back"]).alias("start"), F.size(p["win"]).alias("length"))).alias("hits"), F.flatten(F.transform("found", lambda p: p["items"])).alias("items"))
    return spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = SIZE, most: int = MOST) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of the benchmark."""
    hit = occurrences(spark, docs, items, size, most).select(F.col("doc_id").alias("hit_id"), "text_key")
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["hit_id"]) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == hit["text_key"]), "left_anti")


def hit_words(hits: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda s, h: F.struct(
        (s["n"] + F.greatest(h["start"] + h["length"] - F.greatest(h["start"], s["end"]), F.lit(0))).alias("n"),
        F.greatest(s["end"], h["start"] + h["length"]).alias("end"),
    )
    return F.aggregate(hits, zero, step)["n"]


def op9(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = SIZE, most: int = MOST) -> DataFrame:
    base = keyed(docs).select("doc_id", "text_key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    found = occurrences(spark, docs, items, size, most)
    joined = base.alias("b").join(found.alias("h"), F.expr("b.doc_id <=> h.doc_id AND b.text_key = h.text_key"), "left").select("b.doc_id", "n_words", "hits", "items")
    n_hit = F.coalesce(hit_words(F.col("hits")), F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bs AS (SELECT item, words, unnest(generate_series(1, greatest(len(words) - 9, 1))) AS s FROM b WHERE len(words) > 0),
bw AS (SELECT DISTINCT item, least(len(words), 10) AS size, list_aggregate(words[s:s + 9], 'string_agg', ' ') AS win FROM bs),
sizes AS (SELECT DISTINCT size FROM bw),
ds AS (SELECT doc_id, words, size, unnest(generate_series(1, len(words) - size + 1)) AS s FROM w, sizes WHERE len(words) >= size),
dw AS (SELECT doc_id, size, s, list_aggregate(words[s:s + size - 1], 'string_agg', ' ') AS win FROM ds),
m AS (SELECT dw.doc_id, dw.size, dw.s, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
