"""Project-level rules: configuration tables, skip and ignore rules, locators, layouts, extraction of copy from markup."""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as X
from ..session import ship

# ---- side tables from files ------------------------------------------------------------------------------------------


def lock_tables(spark: SparkSession, toml: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, source_hash), (key, locale, hash, provider, model, at) and (key, locale, review_hash, reason) of a lock file."""
    keys = tomllib.loads(toml).get("keys", {})
    a = [(k, v.get("source")) for k, v in keys.items()]
    b = [(k, loc, r.get("hash"), r.get("provider"), r.get("model"), str(r.get("at", ""))) for k, v in keys.items() for loc, r in v.get("locales", {}).items()]
    c = [(k, loc, r.get("source"), r.get("reason")) for k, v in keys.items() for loc, r in v.get("review", {}).items()]
    return (
        spark.createDataFrame(a, "key string, source_hash string"),
        spark.createDataFrame(b, "key string, locale string, hash string, provider string, model string, at string"),
        spark.createDataFrame(c, "key string, locale string, review_hash string, reason string"),
    )


def glossary_tables(spark: SparkSession, toml: str) -> tuple[DataFrame, DataFrame]:
    g = tomllib.loads(toml)
    terms = [(loc, t, r) for loc, own in g.get("terms", {}).items() for t, r in own.items()]
    return spark.createDataFrame([(t,) for t in g.get("do_not_translate", [])], "term string"), spark.createDataFrame(terms, "locale string, term string, required string")


def memory_table(spark: SparkSession, toml: str) -> DataFrame:
    rows = [(loc, s, e.get("text"), e.get("by")) for loc, own in tomllib.loads(toml).get("locales", {}).items() for s, e in own.items()]
    return spark.createDataFrame(rows, "locale string, source string, text string, by string")


def baseline_table(spark: SparkSession, text: str) -> DataFrame:
    rows = [(f["file"], f["key"], f["locale"], f["code"]) for f in json.loads(text).get("findings", [])]
    return spark.createDataFrame(rows, "file string, key string, locale string, code string")


def lock_lines(keys: DataFrame, locales: DataFrame) -> DataFrame:
    """The lines of a lock file, in its order: each key's hash, then its locales."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    head = keys.select("key", F.lit("").alias("locale"), F.concat(F.lit("[keys."), q(F.col("key")), F.lit("]\nsource = "), q(F.col("source_hash"))).alias("line"))
    own = locales.select("key", "locale", F.concat(F.lit("[keys."), q(F.col("key")), F.lit(".locales."), "locale", F.lit("]\nhash = "), q(F.col("hash"))).alias("line"))
    return head.union(own).orderBy("key", "locale").select("line")


# ---- rules -----------------------------------------------------------------------------------------------------------


def glob(pattern: str) -> str:
    """A key glob as an anchored regular expression; * crosses dots."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def skipped(units: DataFrame, skip: list[str], tool: str) -> Column:
    """Whether a comment directive, or a glob on the base key or on `file set:base key`, skips a unit."""
    base = X.base_key(F.col("key"))
    out = F.coalesce(X.skip_directive(F.col("comment"), tool), F.lit(False))
    for p in skip:
        out = out | base.rlike(glob(p))
        if "file_set" in units.columns:
            out = out | F.concat_ws(":", "file_set", base).rlike(glob(p))
    return out


def unskipped(units: DataFrame, skip: list[str], tool: str) -> DataFrame:
    return units.filter(~skipped(units, skip, tool))


def skipped_keys(units: DataFrame, skip: list[str], tool: str) -> DataFrame:
    """The distinct base keys that unskipped() takes out."""
    return units.filter(skipped(units, skip, tool)).select(X.base_key(F.col("key")).alias("key")).distinct()


def applicable(units: DataFrame, locales: DataFrame) -> DataFrame:
    """Every unit with each locale that it is for. units: locales is null (all) or an array; locales: locale, of a small
    dimension, which is broadcast."""
    pairs = units.crossJoin(F.broadcast(locales.withColumnRenamed("locale", "to_locale")))
    own = pairs.filter(F.col("locales").isNull() | F.array_contains("locales", F.col("to_locale")))
    return own.drop("locales").withColumnRenamed("to_locale", "locale")


def chosen(units: DataFrame, wanted: list[str], targets: list[str]) -> DataFrame:
    """Units of the wanted locales, all of which must be targets."""
    unknown = sorted(set(wanted) - set(targets))
    if unknown:
        raise ValueError(f"not a target locale: {', '.join(unknown)}")
    return units.filter(F.col("locale").isin(wanted)) if wanted else units


def unignored(findings: DataFrame, units: DataFrame, rules: dict[str, list[str]], tool: str, prefixed: bool = False) -> DataFrame:
    """Without findings whose code the key's comment, or a glob for that code, ignores. prefixed: a glob may leave out the
    file set that keys begin with."""
    said = units.select("key", F.explode(X.ignore_directive(F.coalesce("comment", F.lit("")), tool)).alias("code")).distinct()
    out = findings.join(said, ["key", "code"], "left_anti")
    for code, patterns in rules.items():
        for p in patterns:
            at = glob(p)
            hit = X.base_key(F.col("key")).rlike(at)
            if prefixed:
                hit = hit | X.base_key(F.col("key")).rlike("^[^:]*:" + at[1:])
            out = out.filter(~(F.coalesce(F.col("code") == code, F.lit(False)) & F.coalesce(hit, F.lit(False))))
    return out


def too_long(units: DataFrame, tool: str) -> DataFrame:
    """Translations over the limit that their key's comment sets."""
    most = X.max_directive(F.coalesce("comment", F.lit("")), tool)
    return units.filter(F.length("translation") > most).select("key", "locale", F.lit("length").alias("code"), F.lit("error").alias("severity"))


def source_pick(locales: DataFrame, preferred: str) -> DataFrame:
    """path, locale: of each path's locales the preferred one, else English, else the first."""
    rank = F.when(F.col("locale") == preferred, 0).when(F.col("locale") == "en", 1).when(F.col("locale").rlike("^en[-_]"), 2).otherwise(3)
    return locales.groupBy("path").agg(F.min_by("locale", F.struct(rank, "locale")).alias("source_locale"))


def template_locales(paths: DataFrame, template: str) -> DataFrame:
    """path, locale of the paths that fit a template with {locale} or {android_locale}."""
    at = "^" + re.sub(r"\\\{(android_)?locale\\\}", r"([A-Za-z0-9_+-]+)", re.escape(template)) + "$"
    return paths.filter(F.col("path").rlike(at)).select("path", F.regexp_extract("path", at, 1).alias("locale"))


def unlisted(found: DataFrame, listed: list[str], source_locale: str) -> DataFrame:
    """Locale files that no run looks at."""
    return found.filter(X.is_locale(F.col("locale")) & ~F.col("locale").isin(source_locale, *listed))


def located(findings: DataFrame, key_lines: DataFrame) -> DataFrame:
    """findings with the line of their key in their file: the exact key's first line, else its last segment's."""
    exact = key_lines.groupBy("file", "key").agg(F.min("line").alias("line"))
    last = key_lines.groupBy("file", F.element_at(F.split("key", r"\."), -1).alias("segment")).agg(F.min("line").alias("near"))
    rows = findings.join(exact, ["file", "key"], "left").withColumn("segment", F.element_at(F.split("key", r"\."), -1)).join(last, ["file", "segment"], "left")
    return rows.withColumn("line", F.coalesce("line", "near")).drop("near", "segment")


def nested_lines(lines: DataFrame) -> DataFrame:
    """lines: file, line, key (on a key's own line), locale (on a locale's). The key that each locale line stands under."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("under", F.last("key", ignorenulls=True).over(w))
    return rows.filter("locale is not null").select("file", F.col("under").alias("key"), "locale", "line")


def plural_group_gaps(source: DataFrame, target: DataFrame, required: list[str]) -> DataFrame:
    """base, category: forms that a group of suffixed keys needs and the target lacks. A group has `other` and another."""
    at = r"^(.*)_(zero|one|two|few|many|other)$"
    split = lambda d: d.select(F.regexp_extract("key", at, 1).alias("base"), F.regexp_extract("key", at, 2).alias("category")).filter("category <> ''")
    groups = split(source).groupBy("base").agg(F.collect_set("category").alias("c")).filter(F.array_contains("c", "other") & (F.size("c") > 1))
    have = split(target).groupBy("base").agg(F.collect_set("category").alias("have"))
    need = F.array(*[F.lit(c) for c in required])
    return groups.join(have, "base").select("base", F.explode(F.array_except(need, "have")).alias("category"))


def form_gaps(source: DataFrame, target: DataFrame) -> DataFrame:
    """key, variable: plural variables (of plist dictionaries) that the target lacks."""
    return source.select("key", "variable").distinct().join(target.select("key", "variable"), ["key", "variable"], "left_anti")


# ---- copy in markup --------------------------------------------------------------------------------------------------

# Attributes that hold text for people.
ATTRIBUTES = "alt title placeholder label aria-label"


def looks_like_copy(c: Column) -> Column:
    """Text for people: letters of a word or more, and not an address, a number, code or a constant."""
    words = F.size(F.regexp_extract_all(c, F.lit(r"\p{L}{2,}"), F.lit(0)))
    return (words > 0) & ~c.rlike(r"^(https?:|[./#@])") & ~c.rlike(r"^[a-z]+([A-Z_][A-Za-z0-9_]*)+$") & ~c.rlike(r"^[A-Z0-9_]+$") & ~c.rlike(r"[{};=<>]")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, html -> page_id, kind, text: runs between tags and the values of attributes that people read."""
    body = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "<x>")
    runs = F.transform(F.regexp_extract_all(F.concat(F.lit(">"), body, F.lit("<")), F.lit(r">([^<>]+)"), F.lit(1)), lambda x: X.collapsed(x))
    attrs = F.regexp_extract_all(body, F.lit(rf'(?:{"|".join(ATTRIBUTES.split())})="([^"]+)"'), F.lit(1))
    text = pages.select("page_id", F.explode(runs).alias("text")).withColumn("kind", F.lit("text"))
    named = pages.select("page_id", F.explode(attrs).alias("text")).withColumn("kind", F.lit("attribute"))
    return text.union(named).filter(looks_like_copy(F.col("text"))).select("page_id", "kind", "text")


def catalog_keys(copy: DataFrame) -> DataFrame:
    """A key for each distinct text: its first words, and a hash where two texts would share them."""
    base = F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, 4), "_")
    rows = copy.select("text").distinct().withColumn("base", base)
    shared = rows.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(shared, "base").select(F.when(F.col("n") > 1, F.concat("base", F.lit("_"), F.substring(F.sha2("text", 256), 1, 6))).otherwise(F.col("base")).alias("key"), "text")


def outer_object(text: str) -> str | None:
    """The first {...} in a text that is a JSON object, whatever braces the prose around it has."""
    at, decoder = text.find("{"), json.JSONDecoder()
    while at >= 0:
        try:
            _, end = decoder.raw_decode(text, at)
            return text[at:end]
        except ValueError:
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def json_object(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else outer_object(t))


def reply_rows(replies: DataFrame) -> DataFrame:
    """batch, reply -> batch, key, translation: from {"translations": [{key, translation}]} or {key: translation}."""
    ship(replies.sparkSession)
    body = json_object(F.col("reply"))
    full = F.from_json(body, "translations array<struct<key:string,translation:string>>")["translations"]
    short = F.transform(F.map_entries(F.from_json(body, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("translation")))
    return replies.select("batch", F.explode(F.coalesce(full, short)).alias("r")).select("batch", "r.key", "r.translation")


def review_queue(states: DataFrame, locks: DataFrame) -> DataFrame:
    """What people look at: quarantined rows, and up-to-date ones that a model wrote."""
    machine = locks.filter(F.col("provider") != "human").select("key", "locale").distinct().withColumn("_machine", F.lit(True))
    own = states.filter(F.col("state").isin("needs-review", "up-to-date")).select("key", "locale", "state")  # states are read once
    return own.join(machine, ["key", "locale"], "left").filter("state = 'needs-review' or _machine").select("key", "locale", "state")
