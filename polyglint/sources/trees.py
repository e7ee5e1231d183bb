"""Source trees: files to lines, needles and copy; layouts; local mirrors."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import files, locale_of

# What is read, and what is not.
CODE = "swift m mm kt kts java dart ts tsx js jsx mjs cjs vue svelte xml".split()
WEB = "js jsx ts tsx vue svelte html htm astro".split()
SKIPPED = "node_modules Pods build .build DerivedData target dist .next vendor .dart_tool Carthage .gradle out coverage __pycache__".split()
#: What a locale adds to the path of a catalog: its folder, or a part of the file's name.
SET = re.compile(r"(?:(?<=/)|^)(?:values(?:-[^/]+)?(?=/)|[A-Za-z-]+(?=\.lproj/)|[a-z]{2,3}(?:[-_][A-Za-z0-9]+)*(?=/|\.(?:json|po)$))|_[a-z]{2,3}(?:_[A-Za-z0-9]+)*(?=\.arb$)|\.[a-z]{2,3}(?:-[A-Za-z0-9]+)*(?=\.res[xw]$)")
NOT_COPY = r"(\.(test|spec|stories)\.[a-z]+|\.d\.ts|\.generated\.[a-z]+|/(__tests__|tests?|stories)/.*)$"


def is_source(path: Column, extensions: list[str] = CODE) -> Column:
    """A source file outside folders of built or foreign code."""
    return path.rlike(rf"\.({'|'.join(extensions)})$") & ~path.rlike(rf"(^|/)({'|'.join(s.replace('.', '[.]') for s in SKIPPED)})/")


def is_web_source(path: Column) -> Column:
    """A component source that is neither a test, nor a story, nor declared or generated."""
    return is_source(path, WEB) & ~path.rlike(NOT_COPY)


def sources(spark: SparkSession, root: str, extensions: list[str] = CODE, most_bytes: int = 1_000_000) -> DataFrame:
    """path, text of source files; folders of built or foreign code, and files that are too large, are left out unread."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.filter(is_source(F.col("path"), extensions) & (F.col("length") <= most_bytes)).select("path", F.decode("content", "UTF-8").alias("text"))


def web_sources(spark: SparkSession, root: str) -> DataFrame:
    return sources(spark, root, WEB).filter(~F.col("path").rlike(NOT_COPY))


def lines(found: DataFrame) -> DataFrame:
    """file, line, text."""
    return found.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\r?\n", -1)).alias("i", "text")).select("file", (F.col("i") + 1).cast("long").alias("line"), "text")


def key_usages(source_lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Where each key stands first: a quoted literal anywhere beats a bare `.name`; an equality join on what lines quote."""
    quoted = F.regexp_extract_all("text", F.lit(r"""["'`]([^"'`\n]+)["'`]"""), F.lit(1))
    bare = F.regexp_extract_all("text", F.lit(r"(?<![.0-9])\.([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    strong = source_lines.select("file", "line", "text", F.explode(quoted).alias("key"), F.lit(0).alias("rank"))
    weak = source_lines.select("file", "line", "text", F.explode(bare).alias("key"), F.lit(1).alias("rank"))
    hits = strong.union(weak).join(keys.select("key").distinct(), "key")
    return hits.groupBy("key").agg(F.min(F.struct("rank", "file", "line", "text")).alias("at")).select("key", "at.file", "at.line", F.trim("at.text").alias("text"), (F.col("at.rank") == 0).alias("strong"))


def layouts(spark: SparkSession, root: str) -> DataFrame:
    """format, template and locales of the catalogs below a folder: files that differ only in their locale are one layout."""
    found = files(spark, root).drop("content").withColumn("locale", locale_of(F.col("path")))
    spelled = F.regexp_extract("path", r"(?:/values-|_|/|\.)((?:b\+)?[a-z]{2,3}(?:[-_+]r?[A-Za-z0-9]+)*)(?=\.lproj/|\.arb$|\.po$|/LC_MESSAGES/|\.res[xw]$|\.json$|/[^/]+\.(?:xml|json)$)", 1)
    template = F.when(F.col("locale").isNull() | (spelled == ""), F.col("path")).otherwise(F.replace("path", spelled, F.lit("{locale}")))
    return found.groupBy("format", template.alias("template")).agg(F.array_sort(F.collect_set("locale")).alias("locales"))


def mirrored(address: str, cache: str) -> str:
    """A local folder for a git address: cloned once, shallow, and refreshed after that. Runs on the driver."""
    name = "".join(c if c.isalnum() else "-" for c in address).strip("-")
    at = Path(cache) / name
    if at.exists():
        subprocess.run(["git", "-C", str(at), "fetch", "-q", "--depth", "1", "origin", "HEAD"], check=True)
        subprocess.run(["git", "-C", str(at), "reset", "-q", "--hard", "FETCH_HEAD"], check=True)
    else:
        subprocess.run(["git", "clone", "-q", "--depth", "1", address, str(at)], check=True)
    return str(at)


def remote(address: Column) -> Column:
    """Whether an address is a git one or `owner/repository`; whether such a folder is there, only the caller can see."""
    return address.rlike(r"^(?:(?:https?|ssh|git|file)://|git@[^:]+:)|^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")


def single_file(path: str, most_up: int = 4) -> tuple[str, str] | None:
    """For one catalog file: the folder, at most four parents up, whose layout has a locale beside it, and the file's path
    below it. None if no parent has one."""
    file = Path(path)
    for up in list(file.parents)[: most_up + 1]:
        name = str(file.relative_to(up))
        here = SET.sub("", name)
        if any(SET.sub("", str(other.relative_to(up))) == here and other != file for other in up.rglob(f"*{file.suffix}")):
            return str(up), name
    return None


def is_remote(address: str) -> bool:
    return bool(re.match(r"(https?|ssh|git|file)://|git@[^:]+:", address) or re.fullmatch(r"[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+", address) and not Path(address).exists())
