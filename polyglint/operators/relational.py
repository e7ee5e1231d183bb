"""Joins, aggregates and windows over catalogs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..functions import text as X
from ..session import dealt, ship

#: Rows of a side table that may be broadcast; beyond it, Spark chooses.
MOST = 100_000


def small(df: DataFrame, most: int = MOST) -> DataFrame:
    """A broadcast hint only where a count has shown that the side is small."""
    return F.broadcast(df) if df.count() <= most else df


# ---- change tracking -------------------------------------------------------------------------------------------------


def status(units: DataFrame, keys: DataFrame, locales: DataFrame, reviews: DataFrame) -> DataFrame:
    """units: key, locale, source, translation; keys: key, source_hash; locales: key, locale, hash; reviews: key, locale,
    review_hash. Adds state; the first condition that holds decides."""
    # hashes are taken before the rows are shuffled, so that texts travel only to a caller who asks for them
    has = F.coalesce(F.col("translation") != "", F.lit(False))
    u = units.select(*units.columns, has.alias("_has"), X.content_hash(F.col("source")).alias("_source"), X.content_hash(F.col("translation")).alias("_target"))
    j = u.join(keys, "key", "left").join(locales, ["key", "locale"], "left").join(reviews, ["key", "locale"], "left")
    has, source, target = F.col("_has"), F.col("_source"), F.col("_target")
    state = (
        F.when(F.col("source_hash").isNull(), F.when(has, "edited").otherwise("new"))
        .when(F.col("hash").isNull() & ~has, F.when(F.col("review_hash") == source, "needs-review").otherwise("new"))
        .when(~has, "untranslated")
        .when(F.col("hash").isNull(), "edited")
        .when(F.col("hash") != target, "edited")
        .when(F.col("source_hash") != source, "stale")
        .otherwise("up-to-date")
    )
    return j.select(*units.columns, state.alias("state"))


def state_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("locale", "state").agg(F.count(F.lit(1)).alias("n"))


def coverage(states: DataFrame) -> DataFrame:
    open_ = F.col("state").isin("new", "untranslated", "needs-review")
    return states.groupBy("locale").agg(F.count(F.lit(1)).alias("total"), F.greatest(F.count(F.lit(1)) - F.count_if(open_), F.lit(0)).cast("long").alias("done"))


def unit_coverage(units: DataFrame) -> DataFrame:
    """Of each locale the units there are, and those that have a value."""
    return units.groupBy("locale").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col("translation"), F.lit("")) != "").alias("done"))


def work(states: DataFrame, with_reviews: bool = False) -> DataFrame:
    """What an incremental run still has to do."""
    return states.filter(F.col("state").isin("new", "stale", "untranslated", *(["needs-review"] if with_reviews else [])))


def record(locks: DataFrame, done: DataFrame, units: DataFrame) -> DataFrame:
    """Lock rows after a run: done (key, locale, hash) replaces what was there; keys that are gone are pruned."""
    merged = locks.join(done.withColumnRenamed("hash", "new_hash"), ["key", "locale"], "full").select("key", "locale", F.coalesce("new_hash", "hash").alias("hash"))
    return merged.join(units.select("key").distinct(), "key", "left_semi")


# ---- side tables -----------------------------------------------------------------------------------------------------


def orphans(target: DataFrame, source: DataFrame) -> DataFrame:
    """Keys (file, key) that the source lacks; a plural sibling of a source's `_other` key is none."""
    base = F.regexp_extract("key", r"^(.*)_(?:zero|one|two|few|many|other)$", 1)
    lost = target.join(source.select("key"), "key", "left_anti")
    sibling = source.filter(F.col("key").endswith("_other")).select(F.regexp_replace("key", "_other$", "").alias("base"))
    return lost.withColumn("base", base).join(sibling, "base", "left_anti").drop("base")


def against_baseline(findings: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings that are new, and baseline rows that match none any more."""
    on = ["file", "key", "locale", "code"]
    return findings.join(baseline.select(on), on, "left_anti"), baseline.join(findings.select(on), on, "left_anti")


def glossary(units: DataFrame, terms: DataFrame) -> DataFrame:
    """terms: locale, term, required (of a bounded glossary). Units whose source holds a term and whose translation lacks
    its rendering."""
    hit = F.contains(F.lower("source"), F.lower("term")) & ~F.contains(F.lower("translation"), F.lower("required"))
    return units.join(small(terms), "locale").filter(hit).select("key", "locale", "term")


def recall(wanted: DataFrame, memory: DataFrame) -> DataFrame:
    """wanted: key, locale, source. Human translations of the same trimmed source, if their placeholders agree; of several
    texts for one source the least."""
    from ..functions.placeholders import mismatch_udf
    from ..session import ship

    ship(wanted.sparkSession)
    m = memory.filter("by = 'human'").select("locale", X.trimmed(F.col("source")).alias("trimmed"), "text").groupBy("locale", "trimmed").agg(F.min("text").alias("text"))
    both = wanted.withColumn("trimmed", X.trimmed(F.col("source"))).join(m, ["locale", "trimmed"])
    odd = both.filter(F.col("source").rlike("[%{$]") | F.col("text").rlike("[%{$]"))
    plain = both.filter(~(F.col("source").rlike("[%{$]") | F.col("text").rlike("[%{$]")))
    safe = odd.filter(mismatch_udf("source", "text", "locale", F.lit(None).cast("string")).isNull())
    return plain.unionByName(safe).select("key", "locale", "text")


def merge_memory(memory: DataFrame, learned: DataFrame) -> DataFrame:
    """locale, source, text, by, seq: a human's text beats a model's, a later one an earlier one of the same kind; empty
    texts and copies of the source teach nothing."""
    rows = memory.unionByName(learned).filter((X.trimmed(F.col("text")) != "") & (F.col("text") != F.col("source")))
    rank = F.struct((F.col("by") == "human").alias("human"), "seq")
    return rows.groupBy("locale", "source").agg(F.max_by("text", rank).alias("text"), F.max_by("by", rank).alias("by"))


# ---- votes, similarity, usage ----------------------------------------------------------------------------------------


def inconsistent(units: DataFrame) -> DataFrame:
    """Minority translations of short terms. A tie is a choice, an inflection the same word, a copy no vote."""
    src, t = X.trimmed(F.col("source")), X.trimmed(F.col("translation"))
    terms = units.filter(X.plural_base(F.col("key")) == "").select("key", "locale", src.alias("source"), t.alias("translation"))
    words = F.size(F.regexp_extract_all("source", F.lit(r"[^\s\p{Z}]+"), F.lit(0)))
    terms = terms.filter((words.between(1, 3)) & ~F.col("source").rlike(r"[%{<$]") & (X.letters(F.col("source")) >= 3) & (F.col("translation") != F.col("source")))
    terms = terms.withColumn("low", F.lower("translation"))
    votes = terms.groupBy("locale", "source", "low").agg(F.count(F.lit(1)).alias("n"))
    ranked = votes.withColumn("r", F.row_number().over(Window.partitionBy("locale", "source").orderBy(F.desc("n"), "low")))
    tops = ranked.groupBy("locale", "source").agg(F.max(F.when(F.col("r") == 1, F.col("low"))).alias("majority"), F.max(F.when(F.col("r") == 1, F.col("n"))).alias("n"), F.max(F.when(F.col("r") == 2, F.col("n"))).alias("second"))
    tops = tops.filter(F.col("second") < F.col("n")).select("locale", "source", "majority", "n")
    lost = terms.join(tops, ["locale", "source"]).filter((F.col("low") != F.col("majority")) & ~X.inflection(F.col("low"), F.col("majority")))
    return lost.select("key", "locale", "source", "translation", "majority", "n")


def similar(queries: DataFrame, candidates: DataFrame, k: int = 3) -> DataFrame:
    """queries: qid, source; candidates: cid, source, translation. The k most similar candidates that share a token.

    Pairs come from an equality join on tokens; what two rows share is counted over short rows, which hold no text. Few
    queries are broadcast: a candidate's counts are then made in its task, and only the best of a task are shuffled.
    """

    def words(rows: DataFrame, side: str) -> DataFrame:
        """A row for each token of a source. Rows that share an id are told apart."""
        own = rows.select(f"{side}id", F.monotonically_increasing_id().alias(f"{side}row"), F.octet_length("source").alias(f"{side}bytes"), F.unhex(F.sha2("source", 256)).alias(f"{side}hash"), X.tokens(F.col("source")).alias("tokens"))
        return own.withColumn(f"{side}n", F.size("tokens")).withColumn("token", F.explode("tokens")).drop("tokens")

    q = words(queries, "q")
    few = q.count() <= MOST
    c = candidates.filter(X.trimmed(F.col("translation")) != "").filter(F.lower(X.trimmed(F.col("source"))) != F.lower(X.trimmed(F.col("translation")))).select("cid", "source")
    c = words(dealt(c, "cid") if few else c, "c")
    hits = c.join(F.broadcast(q) if few else q, "token").filter("qhash <> chash")
    pairs = hits.groupBy("cid", "crow", "cbytes", "cn", "qid", "qrow", "qbytes", "qn").agg(F.count(F.lit(1)).alias("both"))
    score = F.col("both") / (F.col("qn") + F.col("cn") - F.col("both")) - F.abs(F.col("qbytes") - F.col("cbytes")) / 200
    rated = pairs.select("qid", "cid", F.round(score * 1_000_000).cast("long").alias("millionths"))
    w = Window.partitionBy("qid").orderBy(F.desc("millionths"), "cid")  # whole numbers: ties are ties
    # the limit is on the rank alone, so that Spark applies it before it shuffles
    best = rated.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select("qid", "cid", (F.col("millionths") / 1_000_000).alias("score"), F.col("rank").cast("long").alias("rank"))


def usages(lines: DataFrame, needles: DataFrame) -> DataFrame:
    """lines: file, line, text; needles: needle. Where each word needle stands first: an equality join on words."""
    words = lines.select("file", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("needle"))
    hits = words.join(small(needles), "needle")
    return hits.groupBy("needle").agg(F.min(F.struct("file", "line")).alias("at"), F.count(F.lit(1)).alias("n")).select("needle", "at.file", "at.line", "n")


def enclosing(lines: DataFrame, strong: Column, weak: Column) -> DataFrame:
    """The nearest strong declaration at or above each line of its file, else the nearest weak one."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c: F.last(F.when(c, F.col("line")), ignorenulls=True).over(w)
    return lines.select("file", "line", F.coalesce(at(strong), at(weak)).alias("declared_at"))


def clipped(text: Column, most: int) -> Column:
    """At most so many bytes of UTF-8, no character cut."""
    longest = F.array_max(F.filter(F.sequence(F.lit(most // 4), F.lit(most)), lambda k: F.octet_length(F.substr(text, F.lit(1), k)) <= most))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substr(text, F.lit(1), longest))


def snippets(lines: DataFrame, radius: int = 6, clip: int = 200, dedent: bool = True) -> DataFrame:
    """Lines around each line, each cut to `clip` bytes, without their common indent, or as they stand."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(-radius, radius)
    own = lines.select("file", "line", clipped(F.col("text"), clip).alias("text"))
    if not dedent:
        return own.select("file", "line", F.array_join(F.collect_list("text").over(w), "\n").alias("snippet"))
    indent = F.when(X.trimmed(F.col("text")) != "", F.length(F.regexp_extract("text", r"^\s*", 0)))
    rows = own.select("file", "line", F.collect_list("text").over(w).alias("near"), F.coalesce(F.min(indent).over(w), F.lit(0)).alias("indent"))
    short = lambda x: F.when(F.length(x) >= F.col("indent"), F.substr(x, F.col("indent") + 1)).otherwise(F.ltrim(x))
    return rows.select("file", "line", F.array_join(F.transform("near", short), "\n").alias("snippet"))


# ---- batches, budgets, ranks -----------------------------------------------------------------------------------------


def folded(rows: DataFrame, group: str, order: list[str], out: str, kind: str, start: Callable[[], object], step: Callable[[object, tuple], object]) -> DataFrame:
    """A fold over each group's rows in order that gives every row a value: a state is carried along sorted partitions, so
    a task holds one state and one batch of rows, whatever a group's size. step(state, row) -> (state, value)."""
    ship(rows.sparkSession)
    names = [group, *order]
    schema = StructType([*[rows.schema[c] for c in names], StructField(out, StringType() if kind == "string" else LongType() if kind == "long" else BooleanType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for frame in frames:
            values = []
            for row in frame.itertuples(index=False, name=None):
                if row[0] != at:
                    at, state = row[0], start()
                state, value = step(state, row)
                values.append(value)
            yield frame[names].assign(**{out: values})

    return rows.repartition(group).sortWithinPartitions(*names).mapInPandas(run, schema)


def greedy_batches(rows: DataFrame, group: str, order: str, size: str, most: int = 20, most_chars: int = 2500) -> DataFrame:
    """Cuts each group's rows, in order, into batches of at most `most` rows and most_chars characters: a fold, as every
    cut starts the sums anew."""

    def step(state: tuple, row: tuple) -> tuple:
        batch, n, chars = state
        z = int(row[2])
        if n and (n >= most or chars + z > most_chars):
            batch, n, chars = batch + 1, 0, 0
        return (batch, n + 1, chars + z), batch

    return folded(rows.select(group, order, size), group, [order, size], "batch", "long", lambda: (0, 0, 0), step).drop(size)


def chunks(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / n))


def within_budget(rows: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose costs add up to the budget at most."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)


def first_per_code(findings: DataFrame, n: int = 20) -> DataFrame:
    """What a text report shows of each code, and how many rows it leaves out."""
    w = Window.partitionBy("code").orderBy("file", "locale", "key")
    # the limit is on the rank alone, so that Spark applies it before it shuffles; codes are few
    first = findings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))
    hidden = findings.groupBy("code").agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).cast("long").alias("hidden"))
    return first.join(small(hidden), "code").select(*findings.columns, "rank", "hidden")


def duplicate_keys(entries: DataFrame) -> DataFrame:
    """entries: file, kind, key, ordinal."""
    return entries.groupBy("file", "kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first")).filter("n > 1")


def first_fix(findings: DataFrame) -> DataFrame:
    w = Window.partitionBy("key", "locale").orderBy("file", "code")
    return findings.filter("fix is not null").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


# ---- plurals, arrays, diffs ------------------------------------------------------------------------------------------


def plural_gaps(forms: DataFrame, required: DataFrame, default: tuple[str, ...] = ("one", "other")) -> DataFrame:
    """forms: key, locale, category. Categories a locale needs and a plural lacks; only `other` (and =N) opts out."""
    have = forms.groupBy("key", "locale").agg(F.collect_set("category").alias("have"))
    have = have.filter(F.array_join(F.filter("have", lambda c: ~F.startswith(c, F.lit("="))), ",") != "other").withColumn("lang", X.language(F.col("locale")))
    need = required.groupBy("lang").agg(F.collect_set("category").alias("need"))
    gaps = have.join(small(need), "lang", "left").withColumn("need", F.coalesce("need", F.array(*map(F.lit, default))))
    return gaps.select("key", "locale", F.explode(F.array_except("need", "have")).alias("category"))


def plural_units(forms: DataFrame, needed: DataFrame) -> DataFrame:
    """forms: key, category, source; needed: category (distinct). A unit per category; a missing source text falls back
    to `other`, else to the last category."""
    fallback = F.coalesce(F.max(F.when(F.col("category") == "other", F.col("source"))), F.max_by("source", "category"))
    keys = forms.filter("key is not null").groupBy("key").agg(fallback.alias("fallback"), F.collect_list(F.struct("category", "source")).alias("forms"))  # forms are read once
    own = F.filter(F.transform("forms", lambda x: x["category"]), lambda c: (c == "zero") | F.startswith(c, F.lit("=")))
    rows = keys.crossJoin(F.broadcast(needed.agg(F.collect_set("category").alias("needed"))))  # one row
    rows = rows.select("key", "fallback", "forms", F.explode(F.array_union("needed", own)).alias("category"))
    texts = F.transform(F.filter("forms", lambda x: x["category"] == F.col("category")), lambda x: x["source"])
    rows = rows.select("key", "category", "fallback", F.explode(F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit(None).cast("string")))).alias("source"))
    return rows.select(F.concat("key", F.lit("#plural."), "category").alias("key"), F.coalesce("source", "fallback").alias("source"))


def array_units(arrays: DataFrame) -> DataFrame:
    """arrays: key, items. A row per item, with the whole list as its note."""
    rows = arrays.select("key", "items", F.posexplode("items").alias("i", "source"))
    return rows.select(F.concat("key", F.lit("#array."), F.col("i").cast("string")).alias("key"), "source", F.concat(F.lit("one of: "), F.array_join("items", ", ")).alias("comment"))


def array_parity(source: DataFrame, target: DataFrame) -> DataFrame:
    """name, item: arrays whose numbers of items differ."""
    a, b = source.groupBy("name").agg(F.count("item").alias("n_source")), target.groupBy("name").agg(F.count("item").alias("n_target"))
    return a.join(b, "name").filter("n_source <> n_target")


def changed_lines(diff: DataFrame) -> DataFrame:
    """diff: seq, text of a unified diff, in one file per `part`. file and line of every line on the new side of a hunk."""
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = diff.withColumn("file", F.last(F.when(F.col("text").startswith("+++ b/"), F.substring("text", 7, 1 << 20)), ignorenulls=True).over(w))
    hunk = r"^@@ -\S+ \+([0-9]+)(?:,([0-9]+))? @@"
    rows = rows.filter(F.col("text").rlike(hunk)).select("file", F.regexp_extract("text", hunk, 1).cast("int").alias("c"), F.regexp_extract("text", hunk, 2).alias("d"))
    rows = rows.withColumn("d", F.when(F.col("d") == "", F.lit("1")).otherwise(F.col("d")).cast("int")).filter("d > 0")
    return rows.select("file", F.explode(F.sequence(F.col("c"), F.col("c") + F.col("d") - 1)).alias("line")).distinct()


def placed(findings: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings on changed lines, and the rest."""
    return findings.join(lines, ["file", "line"], "left_semi"), findings.join(lines, ["file", "line"], "left_anti")


def line_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, line, text of lines that differ, in files of as many lines as before."""
    same = before.groupBy("file").agg(F.count(F.lit(1)).alias("n")).join(after.groupBy("file").agg(F.count(F.lit(1)).alias("n")), ["file", "n"]).select("file")
    b = before.select("file", "line", F.col("text").alias("old"))
    return after.join(same, "file", "left_semi").join(b, ["file", "line"]).filter("old <> text").select("file", "line", "old", "text")


def limited(events: DataFrame, key: str, time: str, order: str, most: int, window_seconds: int) -> DataFrame:
    """Sliding-window admission, in event order: at most `most` accepted events in any window; rejected ones don't count."""
    from collections import deque

    window = window_seconds * 1_000_000

    def step(live: deque, row: tuple) -> tuple:
        while live and live[0] <= row[1] - window:
            live.popleft()
        ok = len(live) < most
        if ok:
            live.append(row[1])
        return live, ok

    rows = events.select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("_at"), order)
    return folded(rows, key, ["_at", order], "accepted", "boolean", deque, step).drop("_at")


# ---- small aggregates ------------------------------------------------------------------------------------------------


def severity_totals(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def retained(findings: DataFrame, locales: list[str]) -> DataFrame:
    """Findings of some locales, and those of none."""
    return findings.filter(F.col("locale").isin(locales) | F.col("locale").isNull())


def findings_per_line(findings: DataFrame) -> DataFrame:
    return findings.filter("line is not null").groupBy("file", "line").agg(F.count(F.lit(1)).alias("n"))


def keys_by_locale(rows: DataFrame) -> DataFrame:
    """locale, keys: sorted, each once."""
    return rows.select("locale", "key").distinct().groupBy("locale").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def baseline_rows(findings: DataFrame) -> DataFrame:
    """What a baseline file holds, in its order."""
    return findings.select("file", "key", "locale", "code").distinct().orderBy("file", "key", "locale", "code")


def in_report_order(findings: DataFrame) -> DataFrame:
    """With place: where a finding stands among those of its file."""
    w = Window.partitionBy("file").orderBy("locale", "key", "code")
    return findings.withColumn("place", F.row_number().over(w).cast("long")).orderBy("file", "place")


def in_category_order(rows: DataFrame) -> DataFrame:
    """Rows with a plural category, and its rank among the categories; unknown ones come last."""
    from .. import dims

    rank = F.create_map(*[F.lit(x) for k, c in enumerate(dims.CATEGORY_ORDER) for x in (c, k)])[F.col("category")]
    return rows.withColumn("rank", F.coalesce(rank, F.lit(len(dims.CATEGORY_ORDER)))).orderBy("rank")


def plural_groups(keys: DataFrame) -> DataFrame:
    """base, n of keys whose suffixes are plural categories: `other` and another at least."""
    at = r"(?s)^(.*)_(zero|one|two|few|many|other)$"
    own = keys.select(F.regexp_extract("key", at, 1).alias("base"), F.regexp_extract("key", at, 2).alias("category")).filter("category <> ''").distinct()
    groups = own.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("category") == "other").alias("other"))
    return groups.filter("other = 1 and n > 1").select("base", "n")


def placeholder_counts(rows: DataFrame, text: str) -> DataFrame:
    """key, token, n: the placeholders of a column by the whole grammar."""
    from ..functions.placeholders import extract_udf
    from ..session import ship

    ship(rows.sparkSession)
    return rows.select("key", F.explode(extract_udf(F.col(text))).alias("token")).groupBy("key", "token").agg(F.count(F.lit(1)).alias("n"))


def lost_placeholders(units: DataFrame) -> DataFrame:
    """key, token, lost: how many more of a placeholder the source has."""
    t = placeholder_counts(units, "translation").withColumnRenamed("n", "m")
    both = placeholder_counts(units, "source").join(t, ["key", "token"], "left")
    return both.select("key", "token", (F.col("n") - F.coalesce("m", F.lit(0))).alias("lost")).filter("lost > 0")


def memory_counts(memory: DataFrame) -> DataFrame:
    return memory.groupBy("locale").agg(F.count_if(F.col("by") == "human").alias("human"), F.count_if(F.col("by") == "model").alias("model"))


def forget(memory: DataFrame, locale: str | None = None) -> DataFrame:
    """The memory without a locale, or without all."""
    return memory.filter(F.lit(False) if locale is None else F.col("locale") != locale)


def unedited(flagged: DataFrame, edited: DataFrame, on: list[str]) -> DataFrame:
    """What is flagged and no human has edited."""
    return flagged.join(edited.select(*on).distinct(), on, "left_anti")


def preference(pairs: DataFrame) -> DataFrame:
    """pairs: locale, a, b (outputs), first and second (a blind judge's votes, A, B or TIE; second with the two swapped).
    A win counts only if both votes name the same output; equal outputs tie unasked; pairs that lack one count as missing."""
    a, b = X.trimmed(F.col("a")), X.trimmed(F.col("b"))
    said = F.when((F.col("first") == "A") & (F.col("second") == "B"), "win").when((F.col("first") == "B") & (F.col("second") == "A"), "loss").otherwise("tie")
    verdict = F.when(F.coalesce(a, F.lit("")).isin("") | F.coalesce(b, F.lit("")).isin(""), "missing").when(a == b, "same").otherwise(said)
    v = pairs.select("locale", verdict.alias("v"))
    return v.groupBy("locale").agg(F.count_if(F.col("v") == "win").alias("wins"), F.count_if(F.col("v") == "loss").alias("losses"), F.count_if(F.col("v").isin("tie", "same")).alias("ties"), F.count_if(F.col("v") == "same").alias("identical"))
