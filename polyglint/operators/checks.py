"""Unit-level findings: one row per (translation, code). Input columns: key, locale, source, translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import SEVERITY
from ..functions import placeholders as P
from ..functions import text as X
from ..session import ship


def simple_checks(source_locale: str = "en", ratio: float = 2.5) -> dict[str, Column]:
    """Conditions that need no Python; a blank translation is only `empty`."""
    s, t, loc = F.col("source"), F.col("translation"), F.col("locale")
    filled = X.trimmed(t) != ""
    return {
        "empty": X.blank(s, t),
        "identical": X.identical(s, t, F.lit(source_locale), loc),
        "markup": X.markup(s, t),
        "whitespace": X.whitespace(s, t),
        "punctuation": filled & X.punctuation(s, t),
        "length": X.length(s, t, ratio),
        "encoding": filled & X.encoding(t),
        "invisible": filled & X.invisible(t),
        "link": filled & X.link(s, t),
        "brackets": filled & X.brackets(s, t),
        "entities": filled & X.entities(t),
    }


def simple_findings(units: DataFrame, source_locale: str = "en", ratio: float = 2.5) -> DataFrame:
    """All simple checks in one pass over the units: an array of codes, exploded."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in simple_checks(source_locale, ratio).items()]))
    rows = units.select("key", "locale", F.explode(found).alias("code"))
    return rows.withColumn("severity", severity(F.col("code")))


def severity(code: Column) -> Column:
    return F.when(code.isin([c for c, s in SEVERITY.items() if s == "error"]), "error").otherwise("warning")


def placeholder_findings(spark: SparkSession, units: DataFrame) -> DataFrame:
    """key, locale, code, severity, message, fix. Prose without %, { or $ never reaches Python."""
    ship(spark)
    maybe = units.filter(F.concat("source", "translation").rlike(r"[%{$]") & (X.trimmed(F.col("translation")) != ""))
    category = F.nullif(X.plural_category(F.col("key")), F.lit(""))
    rows = maybe.select("key", "locale", "source", "translation", P.mismatch_udf("source", "translation", "locale", category).alias("message")).filter("message is not null")
    return rows.select("key", "locale", F.lit("placeholders").alias("code"), F.lit("error").alias("severity"), "message", P.repair_udf("source", "translation").alias("fix"))


def icu_plural_findings(spark: SparkSession, units: DataFrame) -> DataFrame:
    ship(spark)
    maybe = units.filter(F.col("translation").rlike(r"\{[^{}]*,\s*plural"))
    gaps = maybe.select("key", "locale", F.explode(P.plural_gaps_udf("translation", "locale")).alias("gap"))
    return gaps.select("key", "locale", F.lit("plural").alias("code"), F.lit("error").alias("severity"), F.concat(F.lit("missing "), "gap").alias("message"), F.lit(None).cast("string").alias("fix"))


def fragment_findings(units: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Lower-case Latin words of the source left in a translation whose letters are mostly not Latin."""
    from ..dims import LOANWORDS

    s, t = X.prose(F.col("source")), X.prose(F.col("translation"))
    latin = F.length(t) - F.length(F.regexp_replace(t, "[A-Za-zÀ-ɏ]", ""))
    words = F.regexp_extract_all(t, F.lit(r"(?:^|[\s\p{Z}(])[\"(“«]*([a-zà-öø-ɏ]{3,})[.,!?:;)\"”»]*(?=$|[\s\p{Z}])"), F.lit(1))
    known = F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    skip = [*LOANWORDS, *(allowed or [])]
    left = F.filter(F.array_distinct(words), lambda w: ~w.isin(skip) & F.array_contains(known, w))
    rows = units.filter((X.letters(t) > 0) & (latin * 2 <= X.letters(t))).select("key", "locale", left.alias("left"))
    return rows.filter(F.size("left") > 0).select("key", "locale", F.lit("fragment").alias("code"), F.lit("warning").alias("severity"), F.array_join("left", ",").alias("message"))


def fixable(findings: DataFrame, codes: tuple[str, ...] = ("placeholders", "markup", "empty", "glossary", "length")) -> DataFrame:
    """Distinct keys per locale that another translation may mend: errors without a mechanical fix."""
    return findings.filter((F.col("severity") == "error") & F.col("code").isin(*codes) & F.col("fix").isNull()).select("locale", "key").distinct()
