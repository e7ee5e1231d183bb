"""Model-backed steps as staged DataFrames, with a deterministic provider that needs no network."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import placeholders as P
from ..functions import text as X
from ..session import ship

Provider = Callable[[Column, Column], Column]


def mock(source: Column, locale: Column) -> Column:
    return F.concat(F.lit("⟦"), locale, F.lit("⟧ "), source)


def prompts(requests: DataFrame) -> DataFrame:
    """requests: key, locale, source, comment, examples (array of source → translation). One user prompt for each."""
    parts = [
        F.concat(F.lit("Translate into "), "locale", F.lit(": "), "source"),
        F.when(F.col("comment").isNotNull(), F.concat(F.lit("Note: "), "comment")),
        F.when(F.size("examples") > 0, F.concat(F.lit("As in: "), F.array_join("examples", "; "))),
    ]
    return requests.withColumn("prompt", F.concat_ws("\n", *parts))


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder; where none is set, as on one machine, in memory and on disk."""
    sc = df.sparkSession.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        return df.persist()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return df.checkpoint()


def retrying(ask: Callable[[str], str], tries: int = 3, first_ms: int = 500, fatal: tuple[type[Exception], ...] = (), sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """ask with retries after 500, 1000 ... milliseconds; a fatal error, and the last one, go through."""

    def run(text: str) -> str:
        for n in range(tries):
            try:
                return ask(text)
            except fatal:
                raise
            except Exception:
                if n == tries - 1:
                    raise
                sleep(first_ms * 2**n / 1000)
        raise ValueError("tries must be positive")

    return run


def problems() -> Column:
    """Why a reply can't be used, or null: blank, placeholders, runaway length (3 times and 20 characters)."""
    s, t = X.trimmed(F.col("source")), X.trimmed(F.col("reply"))
    return F.when(F.col("reply").isNull() | (t == ""), "empty").when(F.col("mismatch").isNotNull(), F.concat(F.lit("placeholders: "), "mismatch")).when(F.length(t) > F.length(s) * 3 + 20, "length")


def translate(spark: SparkSession, requests: DataFrame, provider: Provider = mock, second: Provider | None = None) -> DataFrame:
    """key, locale, source -> reply and state: accepted, repaired (on the second ask) or quarantined with its reason."""
    ship(spark)

    def asked(rows: DataFrame, by: Provider) -> DataFrame:
        rows = rows.withColumn("reply", by(F.col("source"), F.col("locale")))
        rows = rows.withColumn("mismatch", P.mismatch_udf("source", "reply", "locale", F.lit(None).cast("string")))
        return rows.withColumn("problem", problems()).drop("mismatch")

    # first replies are kept: a provider is asked once, and need not answer alike twice
    first = kept(asked(requests.select("key", "locale", "source"), provider))
    good = first.filter("problem is null").withColumn("state", F.lit("accepted"))
    again = asked(first.filter("problem is not null").select("key", "locale", "source"), second or provider)
    return good.unionByName(again.withColumn("state", F.when(F.col("problem").isNull(), "repaired").otherwise("quarantined")))


def flagged_verdicts(verdicts: DataFrame, threshold: int = 2) -> DataFrame:
    """key, locale, score: without a verdict (0), or at the threshold or below."""
    return verdicts.filter(F.coalesce("score", F.lit(0)) <= threshold)


def matched_verdicts(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """requests: batch, ordinal, key, source; verdicts: batch, ordinal, name, score. By exact key or source, then by place,
    then by normalised text if just one fits."""
    norm = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    r = requests.withColumn("n", norm(F.col("source")))
    v = verdicts.select("batch", F.col("ordinal").alias("vo"), "name", "score", norm(F.col("name")).alias("vn"))
    # two equality joins: with an OR, only the batch would be left to join on
    named = [r.join(v, (r.batch == v.batch) & (r[c] == v.name)).select(r.batch, r.ordinal, "score", F.lit(1).alias("rank")) for c in ("key", "source")]
    by_key = named[0].union(named[1])
    by_place = r.join(v.filter("name is null"), (r.batch == v.batch) & (r.ordinal == v.vo)).select(r.batch, r.ordinal, "score", F.lit(2).alias("rank"))
    fuzzy = r.join(v, (r.batch == v.batch) & (r.n == v.vn)).select(r.batch, r.ordinal, "score")
    fuzzy = fuzzy.groupBy("batch", "ordinal").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("batch", "ordinal", "score", F.lit(3).alias("rank"))
    best = by_key.union(by_place).union(fuzzy).groupBy("batch", "ordinal").agg(F.min_by("score", "rank").alias("score"))
    return requests.join(best, ["batch", "ordinal"], "left")
