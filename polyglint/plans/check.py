"""The main queries, end to end: check a folder of catalogs; plan and run incremental translation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as X
from ..operators import checks as C
from ..operators import model as M
from ..operators import project as J
from ..operators import relational as R
from ..sources import catalog
from ..sources.config import Config

COLUMNS = ("path", "line", "key", "locale", "code", "severity", "message", "fix")


def _shaped(df: DataFrame) -> DataFrame:
    """Findings with every column of a report, missing ones null."""
    have = set(df.columns)
    kinds = {"line": "int"}
    return df.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) if c in have else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


@dataclass
class Report:
    findings: DataFrame
    coverage: DataFrame
    entries: DataFrame
    units: DataFrame


def _file_level(entries: DataFrame, source_locale: str) -> list[DataFrame]:
    """entries: placed in file sets, keys unique over sets."""
    ok = entries.filter("error is null and kind <> 'header'").withColumn("locale", F.coalesce("locale", F.lit(source_locale)))
    single = ok.filter("category is null and index is null")
    twice = R.duplicate_keys(single.select(F.concat_ws("\u0001", "path", "locale").alias("file"), "kind", "key", "ordinal")).select(F.split("file", "\u0001")[0].alias("path"), F.split("file", "\u0001")[1].alias("locale"), "key", F.lit("duplicate").alias("code"), F.lit("error").alias("severity"), F.concat(F.lit("appears "), F.col("n").cast("string"), F.lit(" times")).alias("message"))
    kinds = ok.select("path", "format", "key", "locale").distinct()
    source = kinds.filter(F.col("locale") == source_locale).select("key").distinct()
    lost = R.orphans(kinds.filter(F.col("locale") != source_locale).select("path", "locale", "key"), source).select("path", "locale", "key", F.lit("orphan").alias("code"), F.lit("warning").alias("severity"), F.lit("not in the source").alias("message"))
    arrays = ok.filter("kind = 'string-array'").select("path", "locale", F.col("key").alias("name"), F.col("index").alias("item"))
    per = arrays.groupBy("path", "locale", "name").agg(F.count("item").alias("n"))
    want = per.filter(F.col("locale") == source_locale).select("name", F.col("n").alias("n_source"))
    uneven = per.filter(F.col("locale") != source_locale).join(want, "name").filter("n <> n_source").select("path", "locale", F.col("name").alias("key"), F.lit("array").alias("code"), F.lit("error").alias("severity"), F.format_string("%d items, %d in the source", "n", "n_source").alias("message"))
    forms = ok.filter("category is not null").select("key", "locale", "category").distinct()
    spark = entries.sparkSession
    plural = R.plural_gaps(forms.filter(F.col("locale") != source_locale), dims.required_categories(spark)).select("key", "locale", F.lit("plural").alias("code"), F.lit("error").alias("severity"), F.concat(F.lit("missing "), "category").alias("message"))
    wrong = F.when(F.array_contains("flags", "escape-error"), "error").when(F.array_contains("flags", "escape-warning"), "warning")
    escape = ok.withColumn("severity", wrong).filter("severity is not null").select("path", "line", "key", "locale", F.lit("escape").alias("code"), "severity")
    many = ok.filter("format = 'android'").filter(X.unnumbered_arguments(F.col("text")) & ~F.array_contains("flags", "formatted")).select("path", "line", "key", "locale", F.lit("placeholders").alias("code"), F.lit("error").alias("severity"), F.lit("unnumbered arguments").alias("message"))
    return [twice, lost, uneven, plural, escape, many, catalog.flagged_findings(entries), catalog.gettext_header_findings(entries), catalog.syntax_findings(entries)]


def check(spark: SparkSession, root: str, config: Config, baseline: DataFrame | None = None, glossary: DataFrame | None = None) -> Report:
    """All findings below a folder, located, without skipped and ignored ones, in report order; and coverage.

    The configuration's [[files]] say which files belong together, or else their layouts do; keys of a project of several
    file sets are `file set:key`. glossary: locale, term, required.
    """
    entries = catalog.scan(spark, catalog.files(spark, root)).persist()
    placed = catalog.attached(entries, config.files)
    if not config.files:
        placed = catalog.named(placed, root, config.source_locale)
    many = (len(config.files) if config.files else placed.filter("error is null").select("file_set").distinct().count()) > 1
    units = J.unskipped(catalog.units(placed, config.source_locale, config.target_locales), config.skip, config.tool)
    if many:
        units = catalog.prefixed(units)
        placed = catalog.prefixed(placed.filter("error is null")).unionByName(placed.filter("error is not null"))
    units = units.drop("file_set")
    done = units.filter("translation is not null")
    votes = R.inconsistent(done).select("key", "locale", F.lit("inconsistent").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("elsewhere `"), "majority", F.lit("`")).alias("message"))
    own = [C.simple_findings(done, config.source_locale, config.length_ratio), C.placeholder_findings(spark, done), C.icu_plural_findings(spark, done), C.fragment_findings(done), J.too_long(done, config.tool), votes]
    if glossary is not None:
        own.append(R.glossary(done, glossary).select("key", "locale", F.lit("glossary").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("`"), "term", F.lit("` has a fixed rendering")).alias("message")))
    out = None
    for part in [*own, *_file_level(placed, config.source_locale)]:
        out = _shaped(part) if out is None else out.unionByName(_shaped(part))
    out = J.unignored(out, units, config.ignore, config.tool, many)
    lines = placed.filter("error is null").select(F.coalesce("locale", F.lit(config.source_locale)).alias("l_locale"), F.col("key").alias("l_key"), F.col("path").alias("l_path"), F.col("line").alias("l_line"))
    lines = lines.groupBy("l_locale", "l_key").agg(F.min(F.struct("l_path", "l_line")).alias("at"))
    out = out.join(lines, (X.base_key(F.col("key")) == F.col("l_key")) & (F.col("locale") == F.col("l_locale")), "left")
    out = out.withColumn("path", F.coalesce("path", "at.l_path")).withColumn("line", F.coalesce("line", "at.l_line")).select(*COLUMNS)
    if baseline is not None:
        out = R.against_baseline(out.withColumnRenamed("path", "file"), baseline)[0].withColumnRenamed("file", "path")
    return Report(out.orderBy("path", "locale", "key", "code"), R.unit_coverage(units), entries, units)


@dataclass
class Translation:
    recalled: DataFrame
    asked: DataFrame
    batches: DataFrame
    lock: DataFrame


def translate(spark: SparkSession, units: DataFrame, keys: DataFrame, locales: DataFrame, reviews: DataFrame, memory: DataFrame, provider: M.Provider = M.mock, batch_size: int = 20) -> Translation:
    """What changed since the lock is recalled from memory, else asked for in batches; the lock's new rows. Nothing that is
    up to date is touched, so a run that was cut short can be repeated."""
    states = R.status(units.select("key", "locale", "source", "translation"), keys, locales, reviews)
    todo = R.work(states)
    recalled = R.recall(todo.select("key", "locale", "source"), memory).withColumnRenamed("text", "reply")
    asked = M.translate(spark, todo.join(recalled.select("key", "locale"), ["key", "locale"], "left_anti"), provider)
    batches = R.greedy_batches(asked.withColumn("size", F.length("source")), "locale", "key", "size", batch_size)
    done = asked.filter("state <> 'quarantined'").select("key", "locale", "reply").union(recalled.select("key", "locale", "reply"))
    return Translation(recalled, asked, batches, R.record(locales.select("key", "locale", "hash"), done.select("key", "locale", X.content_hash(F.col("reply")).alias("hash")), units))


def fixes(report: Report) -> DataFrame:
    """path, key, locale, value: the mechanical repairs of a report, for catalog.write_values."""
    return R.first_fix(report.findings.withColumn("file", F.col("path"))).select("path", "key", "locale", F.col("fix").alias("value"))

