"""Catalog files as DataFrames: scans, layouts, and writers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import attrgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt, ship
from .formats import PARSERS, Broken, Entry, read_text, splice

ENTRIES = "path string, format string, key string, text string, ordinal int, kind string, locale string, category string, index int, comment string, state string, start int, end int, line int, flags array<string>, error string"

# How a file's name tells its format, and the locale in its path.
LAYOUTS = (
    ("xcstrings", r"\.xcstrings$", None),
    ("arb", r"\.arb$", r"_([a-z]{2,3}(?:_[A-Za-z0-9]+)*)\.arb$"),
    ("po", r"\.pot?$", r"(?:^|[/])([a-z]{2,3}(?:[-_][A-Za-z0-9]+)*)(?:/LC_MESSAGES/[^/]+)?\.po$"),
    ("resx", r"\.res[xw]$", r"\.([a-z]{2,3}(?:-[A-Za-z0-9]+)*)\.res[xw]$"),
    ("stringsdict", r"\.stringsdict$", r"/([A-Za-z-]+)\.lproj/[^/]+$"),
    ("strings", r"\.strings$", r"/([A-Za-z-]+)\.lproj/[^/]+$"),
    ("android", r"/values[^/]*/[^/]+\.xml$", r"/values-([^/]+)/[^/]+$"),
    ("json", r"\.json$", r"(?:^|[/])([a-z]{2,3}(?:[-_][A-Za-z0-9]+)*)(?:/[^/]+)?\.json$"),
)


def format_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, at, _ in reversed(LAYOUTS):
        out = F.when(path.rlike(at), name).otherwise(out)
    return out


def locale_of(path: Column) -> Column:
    """The locale in a path's layout, as a language tag; null for a format or file without one."""
    out = F.lit(None).cast("string")
    for _, at, where in reversed(LAYOUTS):
        if where:
            out = F.when(path.rlike(at), F.nullif(F.regexp_extract(path, where, 1), F.lit(""))).otherwise(out)
        else:
            out = F.when(path.rlike(at), F.lit(None)).otherwise(out)
    tag = F.regexp_replace(F.regexp_replace(out, r"^b\+", ""), r"[+_]|-r(?=[A-Z]{2}$)", "-")
    return F.when(path.rlike(r"/values-(?![a-z]{2,3}($|-r[A-Z]{2}/|/)|b\+)"), F.lit(None)).otherwise(tag)


# Where a layout's path holds its locale; without it, a locale's file and its source's have one name.
_TAG = r"[a-z]{2,3}(?:[-_][A-Za-z0-9]+)*"
SET_OF = (
    ("arb", r"_[a-z]{2,3}(?:_[A-Za-z0-9]+)*(\.arb)$", "$1"),
    ("po", rf"(^|/){_TAG}((?:/LC_MESSAGES/[^/]+)?\.po)$", "$1$2"),
    ("resx", r"\.[a-z]{2,3}(?:-[A-Za-z0-9]+)*(\.res[xw])$", "$1"),
    ("stringsdict", r"/[A-Za-z-]+(\.lproj/[^/]+)$", "/$1"),
    ("strings", r"/[A-Za-z-]+(\.lproj/[^/]+)$", "/$1"),
    ("android", r"/values-[^/]+/", "/values/"),
    ("json", rf"(^|/){_TAG}((?:/[^/]+)?\.json)$", "$1$2"),
)


def file_set(path: Column) -> Column:
    """What a catalog's source file and its locales' files have in common."""
    out = path
    for name, at, by in SET_OF:
        out = F.when(format_of(path) == name, F.regexp_replace(path, at, by)).otherwise(out)
    return out


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, format, layout_locale, content of the catalog files below a folder of any file system Spark reads."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    return rows.select("path", format_of(F.col("path")).alias("format"), locale_of(F.col("path")).alias("layout_locale"), "content").filter("format is not null")


def expanded(template: Column, locale: Column) -> Column:
    """A path template with its locale, as a tag or in Android's spelling."""
    from ..functions.text import android_qualifier

    return F.replace(F.replace(template, F.lit("{locale}"), locale), F.lit("{android_locale}"), android_qualifier(locale))


def locale_pattern(template: str) -> str:
    """Regular expression of the end of the paths that a template names; its group is the locale as the path spells it."""
    out = "".join("((?:b\\+)?[A-Za-z]{2,3}(?:[-_+][A-Za-z0-9]+)*)" if x in ("{locale}", "{android_locale}") else re.escape(x) for x in re.split(r"(\{locale\}|\{android_locale\})", template))
    return f"(?:^|/){out}$"


def attached(entries: DataFrame, specs: list[dict] | None = None) -> DataFrame:
    """Entries with their file_set and the locale of their file. specs: the configuration's [[files]] (path, format,
    locale_path); a file that none of them names belongs to no set and is left out. Without specs, sets follow layouts.

    A set that stands for the source has no locale: its entries' own locale, if they have one, stays.
    """
    path = F.col("path")
    if not specs:
        return entries.withColumn("file_set", file_set(path)).withColumn("locale", F.coalesce("locale", F.nullif(locale_of(path), F.lit("Base"))))
    which, where, kind = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for spec in reversed(specs):
        if spec.get("locale_path"):
            at = locale_pattern(spec["locale_path"])
            hit = path.rlike(at)
            which, kind = F.when(hit, spec["path"]).otherwise(which), F.when(hit, spec["format"]).otherwise(kind)
            where = F.when(hit, F.regexp_extract(path, at, 1)).otherwise(where)
    for spec in reversed(specs):
        hit = path.rlike("(?:^|/)" + re.escape(spec["path"]) + "$")
        which, kind = F.when(hit, spec["path"]).otherwise(which), F.when(hit, spec["format"]).otherwise(kind)
        where = F.when(hit, F.lit(None).cast("string")).otherwise(where)
    tag = F.regexp_replace(F.regexp_replace(where, r"^b\+", ""), r"[+_]|-r(?=[A-Z]{2}$)", "-")
    out = entries.withColumn("file_set", which).withColumn("locale", F.coalesce("locale", tag)).withColumn("_kind", kind)
    return out.filter(F.col("file_set").isNotNull() & (F.col("_kind") == F.col("format"))).drop("_kind")


# Entries that a task holds as Python objects before it gives them on.
_ROWS = 10_000


def scan(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Entries of files (path, format, content); a file that can't be read gives one row with its error and line. Files are
    dealt out by path, so that a table of many small ones is parsed by all tasks."""
    ship(spark)
    names, kinds = zip(*[c.split(" ") for c in ENTRIES.split(", ")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [{"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[k] for k in kinds]
        cells = attrgetter(*names[2:-1])  # of an Entry

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))

        for got in batches:
            rows: list[tuple] = []
            for path, format_, content in zip(*got.columns, strict=True):
                path, format_ = path.as_py(), format_.as_py()
                try:
                    rows += [(path, format_, *cells(e), None) for e in PARSERS[format_](read_text(content.as_py()))]
                except Broken as e:
                    rows.append((path, format_, *cells(Entry("", "", kind="error", line=e.line)), e.message))
                if len(rows) >= _ROWS:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    return dealt(found.select("path", "format", "content"), "path").mapInArrow(run, ENTRIES)


def unit_key() -> Column:
    """An entry's key with its plural category or its place in an array."""
    return F.concat("key", F.when(F.col("category").isNotNull(), F.concat(F.lit("#plural."), "category")).when(F.col("index").isNotNull(), F.concat(F.lit("#array."), F.col("index").cast("string"))).otherwise(""))


def values(entries: DataFrame, source_locale: str) -> DataFrame:
    """file_set, key, locale, text, comment, ordinal, format of entries that attached() placed; later duplicates win."""
    ok = entries.filter("error is null and kind <> 'header'")
    return ok.select("file_set", unit_key().alias("key"), F.coalesce("locale", F.lit(source_locale)).alias("locale"), "text", "comment", "ordinal", "format")


def named(placed: DataFrame, root: str, source_locale: str) -> DataFrame:
    """Placed entries whose sets are called by their source file's path below the root, as a configuration would."""
    path = F.regexp_replace("path", "^(?:[a-z]+:/*)?" + re.escape(re.sub("^[a-z]+:/*", "", root).strip("/")) + "/", "")
    path = F.regexp_replace(path, "^/+", "")
    own = F.when(F.coalesce("locale", F.lit(source_locale)) == source_locale, path)
    names = placed.groupBy("file_set").agg(F.coalesce(F.min(own), F.min(path)).alias("name"))
    return placed.join(names, "file_set").drop("file_set").withColumnRenamed("name", "file_set")


def units(placed: DataFrame, source_locale: str, locales: list[str] | None = None) -> DataFrame:
    """file_set, key, locale, source, translation, comment: source entries beside each target locale's values, file set by
    file set. placed: see attached().

    Empty translations count as absent. Where a source text is missing or empty, its key stands for it in String Catalogs
    and JSON; in gettext the key without its context is the source. Target locales are those of the configuration, or
    else those that a file set has.
    """
    # one row for each key with all that its files say, under columns that no later step prunes: both sides of the join
    # below read the same shuffle, and files are parsed once
    said = F.collect_list(F.struct("locale", "ordinal", "text", "comment", "format"))
    keys = values(placed, source_locale).groupBy("file_set", "key").agg(said.alias("said"))
    others = F.filter("said", lambda x: x["locale"] != source_locale)
    src = F.array_max(F.transform(F.filter("said", lambda x: x["locale"] == source_locale), lambda x: F.struct(x["ordinal"], x["text"], x["comment"], x["format"])))
    texts = F.array_sort(F.transform(F.filter(others, lambda x: x["text"] != ""), lambda x: F.struct(x["locale"], x["ordinal"], x["text"])))
    rows = keys.withColumn("src", src).filter("src is not null").withColumn("texts", texts)
    last = F.filter("texts", lambda x, i: F.coalesce(F.get("texts", i + 1)["locale"] != x["locale"], F.lit(True)))
    rows = rows.withColumn("texts", F.map_from_entries(F.transform(last, lambda x: F.struct(x["locale"], x["text"]))))
    source, format_ = F.col("src.text"), F.col("src.format")
    own = F.when(format_ == "po", F.element_at(F.split(F.regexp_replace("key", "#plural[.][^#]+$", ""), "\u0004"), -1))
    own = own.when(format_.isin("xcstrings", "json"), F.coalesce(F.nullif(source, F.lit("")), "key")).otherwise(source)
    rows = rows.select("file_set", "key", own.alias("source"), F.col("src.comment").alias("comment"), "texts")
    if locales:
        pairs = rows.withColumn("locales", F.array(*[F.lit(x) for x in locales]))
    else:
        have = keys.select("file_set", F.explode(F.array_distinct(F.transform(others, lambda x: x["locale"]))).alias("locale"))
        pairs = rows.join(have.groupBy("file_set").agg(F.collect_set("locale").alias("locales")), "file_set")
    pairs = pairs.withColumn("locale", F.explode("locales"))
    return pairs.select("file_set", "key", "locale", "source", F.col("texts")[F.col("locale")].alias("translation"), "comment")


def prefixed(rows: DataFrame) -> DataFrame:
    """Keys as `file set:key`, for projects of several sets."""
    return rows.withColumn("key", F.concat_ws(":", "file_set", "key"))


def key_listing(entries: DataFrame) -> DataFrame:
    """path, kind, key, ordinal in file order; a key that stands twice is listed twice, an entry of several parts once."""
    ok = entries.filter("error is null and kind <> 'header'")
    first = ok.filter("category is null and (index is null or index = 0)").select("path", "kind", "key", "ordinal")
    plural = ok.filter("category is not null").groupBy("path", "kind", "key").agg(F.min("ordinal").alias("ordinal"))
    return first.unionByName(plural)


def plural_forms(entries: DataFrame, source_locale: str) -> DataFrame:
    """file_set, key, locale, categories (sorted, distinct) of entries that attached() placed and that have plural forms."""
    rows = entries.filter("error is null and category is not null").withColumn("locale", F.coalesce("locale", F.lit(source_locale)))
    return rows.groupBy("file_set", "key", "locale").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def _applied(text: str, format_: str, edits: list, inserting: bool) -> str:
    from .writers import insert, xcstrings_set

    at = {(e["key"], e["locale"], e["category"], e["index"]): e["value"] for e in edits}
    have = {(e.key, e.locale, e.category, e.index) for e in PARSERS[format_](text) if e.start >= 0}
    text = splice(text, format_, {k: v for k, v in at.items() if k in have})
    if not inserting:
        return text
    new: dict[tuple, object] = {}
    for (key, locale, category, index), value in at.items():
        if (key, locale, category, index) in have:
            continue
        if category is not None:
            new.setdefault((key, locale), {})[category] = value
        elif index is not None:
            new.setdefault((key, locale), []).append(value)
        else:
            new[key, locale] = value
    for (key, locale), value in new.items():
        text = xcstrings_set(text, key, locale, value) if format_ == "xcstrings" else insert(text, format_, key, value)
    return text


def write_values(spark: SparkSession, found: DataFrame, edits: DataFrame, inserting: bool = False) -> DataFrame:
    """path, content: the files with edited values (path, key, locale, category, index, value) spliced in, byte for byte
    as they were elsewhere. Edits are gathered by file, so a file's rows meet in one task. Edits of entries that a file
    doesn't have are left out, or inserted."""
    ship(spark)
    by_file = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("key", "locale", "category", "index", "value"))).alias("edits"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, format_, content, own in zip(frame.path, frame.format, frame.content, frame.edits, strict=True):
                data = bytes(content)
                wide = data[:2] in (b"\xff\xfe", b"\xfe\xff")
                text = _applied(read_text(data), format_, list(own), inserting)
                head = data[:2] if wide else b"\xef\xbb\xbf" if data[:3] == b"\xef\xbb\xbf" else b""
                rows.append((path, head + text.encode(("utf-16-le" if data[:2] == b"\xff\xfe" else "utf-16-be") if wide else "utf-8")))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return found.join(by_file, "path").select("path", "format", "content", "edits").mapInPandas(run, "path string, content binary")


def upsert(spark: SparkSession, found: DataFrame, edits: DataFrame) -> DataFrame:
    """write_values() that also inserts entries that a file doesn't have."""
    return write_values(spark, found, edits, inserting=True)


def flush(written: DataFrame) -> None:
    """Writes path, content back, each file by a temporary one beside it that takes its place. The folder must be shared
    by the executors; a task that runs twice writes the same bytes."""

    def run(rows: Iterator) -> None:
        import os
        import re
        import uuid

        for r in rows:
            path = re.sub("^file:/*", "/", r["path"])
            beside = f"{path}.{uuid.uuid4().hex}"
            with open(beside, "wb") as f:
                f.write(bytes(r["content"]))
            os.replace(beside, path)

    written.select("path", "content").foreachPartition(run)


def syntax_findings(entries: DataFrame) -> DataFrame:
    return entries.filter("error is not null").select("path", "line", F.lit("syntax").alias("code"), F.lit("error").alias("severity"), F.col("error").alias("message"))


def flagged_findings(entries: DataFrame) -> DataFrame:
    """fuzzy gettext entries, and catalog units left in a state that isn't final."""
    fuzzy = F.when(F.array_contains("flags", "fuzzy"), "fuzzy")
    state = F.when(F.col("state").isin("needs_review", "stale", "new") | F.array_contains("flags", "stale"), "state")
    found = entries.select("path", "line", "key", "locale", F.explode(F.array_compact(F.array(fuzzy, state))).alias("code"))  # entries are parsed once
    return found.withColumn("severity", F.lit("warning"))


def gettext_header_findings(entries: DataFrame) -> DataFrame:
    """A header whose number of plural forms isn't the language's (error), or plural entries without one (warning)."""
    from ..dims import GETTEXT_NPLURALS

    po = entries.filter("format = 'po' and error is null").withColumn("lang", F.lower(F.split(locale_of(F.col("path")), "[-_]")[0]))
    need = F.coalesce(F.create_map(*[x for k, v in GETTEXT_NPLURALS.items() for x in (F.lit(k), F.lit(v))])[F.col("lang")], F.lit(2))
    per = po.groupBy("path", "lang").agg(F.max(F.when(F.col("kind") == "header", F.regexp_extract("text", r"nplurals\s*=\s*([0-9]+)", 1))).alias("n"), F.count_if(F.col("kind") == "plural").alias("plurals"))
    have = F.nullif("n", F.lit("")).try_cast("int")
    severity = F.when(have.isNull() & (F.col("plurals") > 0), "warning").when(have != need, "error")
    return per.withColumn("severity", severity).filter("severity is not null").select("path", F.lit("plural").alias("code"), "severity")
