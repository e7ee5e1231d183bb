"""Reports over findings (file, line, key, locale, code, severity, message): one row of text per report or item."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import CODES


def json_report(findings: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """A line of JSON per finding, in report order. (A file of lines: the whole report never meets in one task.)"""
    return findings.orderBy("file", "locale", "key", "code").select(F.to_json(F.struct("file", "line", "key", "locale", "code", "severity", "message")).alias("json"))


def json_summary(findings: DataFrame, coverage: DataFrame, baseline_known: int | None = None, baseline_stale: int | None = None) -> DataFrame:
    """One row of JSON with a report's totals: errors, warnings, what was checked, coverage of each locale ([done, total]),
    and the baseline's counts if there is one. What it gathers is a row for each locale."""
    totals = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("locale", F.array("done", "total")))))
    per = coverage.agg(F.coalesce(F.sum("done"), F.lit(0)).alias("checked"), pairs.alias("coverage"))
    parts = ["errors", "warnings", "checked", "coverage"]
    out = totals.crossJoin(per)  # one row each
    if baseline_known is not None:
        out = out.withColumn("baseline", F.struct(F.lit(baseline_known).alias("known"), F.lit(baseline_stale or 0).alias("stale")))
        parts.append("baseline")
    return out.select(F.to_json(F.struct(*parts)).alias("json"))


def sarif_log(findings: DataFrame, tool: str = "polyglint") -> DataFrame:
    """part, text: a SARIF 2.1.0 log as rows to be written in order of part, then of findings: the envelope up to its
    results, the results with commas between them, and the end. No task holds the whole log."""
    head = json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "rules": sarif_rules()}}, "results": []}]}, separators=(",", ":"))
    spark = findings.sparkSession
    ends = spark.createDataFrame([(0, "", head[: -len("]}]}")]), (2, "", "]}]}")], "part int, at string, text string")
    at = F.concat_ws("\u0001", "file", "locale", "key", "code")
    first = findings.agg(F.min(at).alias("first"))
    rows = sarif_results(findings.withColumn("_at", at), keep="_at").crossJoin(first)  # one row
    rows = rows.select(F.lit(1).alias("part"), F.col("_at").alias("at"), F.concat(F.when(F.col("_at") == F.col("first"), "").otherwise(","), "json").alias("text"))
    return ends.union(rows).orderBy("part", "at").select("part", "text")


def job_summary(findings: DataFrame, coverage: DataFrame, rows: int = 100, worst: int = 10) -> DataFrame:
    """part, place, line: a table of the first findings (keys clipped to 60 characters), and the least covered locales."""
    clip = F.when(F.length("key") > 60, F.concat(F.left("key", F.lit(59)), F.lit("…"))).otherwise(F.col("key"))
    order = ["file", "locale", "key", "code"]
    top = findings.orderBy(*order).limit(rows).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # `rows` rows
    a = top.select(F.lit(1).alias("part"), "place", F.concat(F.lit("| "), F.concat_ws(" | ", "severity", "code", "locale", clip, "message"), F.lit(" |")).alias("line"))
    percent = F.floor(100 * F.col("done") / F.greatest("total", F.lit(1)))
    low = coverage.withColumn("percent", percent).orderBy("percent", "locale").limit(worst).withColumn("place", F.row_number().over(Window.orderBy("percent", "locale")))
    return a.union(low.select(F.lit(2), "place", F.format_string("| %s | %d/%d | %d%% |", "locale", "done", "total", "percent")))


def sarif_results(findings: DataFrame, keep: str | None = None) -> DataFrame:
    """A SARIF 2.1.0 result per finding, with a stable fingerprint."""
    mark = F.concat_ws(":", "file", "key", "locale", "code")
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.coalesce("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation")))
    return findings.select(F.to_json(F.struct(F.col("code").alias("ruleId"), F.col("severity").alias("level"), F.struct(F.concat_ws(" ", F.concat(F.lit("["), "locale", F.lit("]")), "key", "message").alias("text")).alias("message"), place.alias("locations"), F.struct(mark.alias("findingKey")).alias("partialFingerprints"))).alias("json"), *([keep] if keep else []))


def sarif_rules() -> list[dict]:
    return [{"id": c, "name": title, "defaultConfiguration": {"level": s}} for c, s, _, title in CODES]


def escaped(c: Column, extra: bool = False) -> Column:
    """Percent-escaping of workflow commands; properties also escape : and ,."""
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *((("," , "%2C"), (":", "%3A")) if extra else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def annotations(findings: DataFrame) -> DataFrame:
    place = F.concat(F.lit("file="), escaped(F.col("file"), True), F.when(F.col("line").isNotNull(), F.concat(F.lit(",line="), F.col("line").cast("string"))).otherwise(""))
    return findings.select(F.concat(F.lit("::"), "severity", F.lit(" "), place, F.lit(",title="), escaped(F.concat("code", F.lit(" "), "locale"), True), F.lit("::"), escaped(F.concat("key", F.lit(": "), "message"))).alias("line"))


def review_comments(findings: DataFrame, most: int = 40) -> DataFrame:
    """One comment per (file, line), errors first; at most `most` of them, as review services accept."""
    text = F.concat(F.lit("**"), "code", F.lit("** ("), "locale", F.lit(") `"), "key", F.lit("`: "), "message")
    items = F.array_sort(F.collect_list(F.struct((F.col("severity") != "error").alias("later"), "code", "locale", text.alias("text"))))
    rows = findings.filter("line is not null").groupBy("file", "line").agg(F.array_join(F.transform(items, lambda x: x["text"]), "\n").alias("body"), F.min((F.col("severity") != "error").cast("int")).alias("rank"))
    return rows.orderBy("rank", "file", "line").limit(most).select("file", "line", "body")


def unsaid(comments: DataFrame, posted: DataFrame) -> DataFrame:
    """Comments for lines that carry none yet."""
    return comments.join(posted.select("file", "line"), ["file", "line"], "left_anti")


def coverage_markdown(coverage: DataFrame) -> DataFrame:
    percent = F.floor(100 * F.col("done") / F.greatest("total", F.lit(1)))
    return coverage.orderBy("locale").select(F.format_string("| %s | %d/%d | %d%% |", "locale", "done", "total", percent).alias("line"))


def text_report(findings: DataFrame, most: int = 20) -> DataFrame:
    """The first rows of each code, and a row that counts the others."""
    from .relational import first_per_code

    shown = first_per_code(findings, most)
    rows = shown.select("code", F.col("rank").alias("at"), F.concat("file", F.lit(" "), "locale", F.lit(" "), "key").alias("line"))
    more = shown.filter((F.col("rank") == 1) & (F.col("hidden") > 0)).select("code", F.lit(most + 1).cast("long").alias("at"), F.concat(F.lit("... and "), F.col("hidden").cast("string"), F.lit(" more")).alias("line"))
    return rows.union(more)


def merged_catalog(existing: DataFrame, extracted: DataFrame) -> DataFrame:
    """key, text: what exists wins; keys of one file are sorted when it is written."""
    return existing.withColumnRenamed("text", "old").join(extracted, "key", "full").select("key", F.coalesce("old", "text").alias("text"), F.col("old").isNull().alias("added"))


def insert_positions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """For each new key (file, key, ordinal) the nearest existing key before it in the source's order, else the one after."""
    both = existing.select("file", "key", "ordinal", F.lit(True).alias("old")).union(new.select("file", "key", "ordinal", F.lit(False)))
    # two frames that end at the row, each carried on: one that reaches ahead would be read again for every row
    back = Window.partitionBy("file").orderBy("ordinal", F.desc("old"), "key").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("file").orderBy(F.desc("ordinal"), "old", F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("old"), F.col("key"))
    return both.select("file", "key", "old", F.last(own, True).over(back).alias("after"), F.last(own, True).over(ahead).alias("before")).filter("not old").drop("old")
