r"""Quality rules as weak supervision: op7. DataFrame operations only.

Each rule votes good (1) or bad (-1) on a document, or abstains (0). There are at most 3 ** len(RULES) patterns of
votes, whatever the corpus; their counts over all documents are what expectation-maximisation needs. It estimates each
rule's chance of each vote on good and on bad documents and the share of good ones; a document's posterior
probability of being good then decides in place of an all-must-pass filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, inputs, saved

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _per(n: str, of: str) -> Column:
    return F.col(n) / F.greatest(F.col(of), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")


def rules() -> dict[str, Column]:
    """Votes over the measures; bad wins where both conditions hold."""
    return {
        "length": _vote(F.col("n_words") >= 80, F.col("n_words") < 50),
        "repeats": _vote(_per("n_repeat_words", "n_words") <= 0.1, _per("n_repeat_words", "n_words") > 0.4),
        "symbols": _vote(_per("n_symbols", "n_words") <= 0.02, _per("n_symbols", "n_words") > 0.25),
        "lines": _vote(_per("n_dup_lines", "n_lines") <= 0.05, _per("n_dup_lines", "n_lines") > 0.3),
        "word_length": _vote(_per("word_chars", "n_words").between(3.5, 9.5), ~_per("word_chars", "n_words").between(2.5, 14)),
        "letters": _vote(_per("n_other", "word_chars") <= 0.08, _per("n_other", "word_chars") > 0.3),
        # distinct words grow with the root of a text's length
        "variety": _vote(F.col("n_distinct") >= 4 * F.sqrt("n_words"), F.col("n_distinct") < 2 * F.sqrt("n_words")),
    }


def _neighbours(a: Column, same, take) -> Column:
    """take(x) of every element of a sorted array that is the same as the one before or after it."""
    after = F.slice(a, 2, F.greatest(F.size(a), F.lit(1)))
    low = F.zip_with(a, after, lambda x, y: F.when(same(x, y), take(x)))
    high = F.zip_with(a, after, lambda x, y: F.when(same(x, y), take(y)))
    return F.array_distinct(F.concat(F.array_compact(low), F.array_compact(high)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that rules use. A null or empty text has no words and one empty line."""
    t = inputs(docs, id_col, text_col)
    t = t.select("doc_id", "text", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "").alias("words"))
    n = F.size("words")
    # a window's hash above its place: equal windows become neighbours when sorted; 32 bits only suggest, words decide
    window = lambda i: (F.xxhash64(F.get("words", i - 1), F.get("words", i), F.get("words", i + 1)).bitwiseAND(F.lit(-1 << 32))).bitwiseOR(i.cast("long"))
    grams = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), window))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    symbols = sum((F.octet_length("text") - F.octet_length(F.replace("text", F.lit(c))) for c in SYMBOLS), F.lit(0))
    t = t.select(
        "doc_id",
        "words",
        n.cast("long").alias("n_words"),
        F.array_join("words", "").alias("joined"),
        symbols.cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        lines.alias("lines"),
        grams.alias("grams"),
    )
    t = t.select(
        "doc_id",
        "words",
        "n_words",
        F.char_length("joined").cast("long").alias("word_chars"),
        F.regexp_count("joined", F.lit(r"[^\p{L}]")).cast("long").alias("n_other"),
        "n_symbols",
        "n_lines",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        _neighbours(F.col("grams"), lambda x, y: F.shiftrightunsigned(x, 32) == F.shiftrightunsigned(y, 32), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("maybe"),
    )
    text_at = lambda i: F.struct(F.concat_ws(" ", F.get("words", i - 1), F.get("words", i), F.get("words", i + 1)).alias("w"), i.alias("i"))
    t = t.withColumn("same", F.when(F.size("maybe") > 0, F.array_sort(F.transform("maybe", text_at))))
    t = t.withColumn("at", F.when(F.size("maybe") > 0, F.array_sort(_neighbours(F.col("same"), lambda x, y: x["w"] == y["w"], lambda x: x["i"]))))
    gaps = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    repeated = F.when(F.size("maybe") > 0, F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long"))
    # a column that isn't deterministic: filters on votes stop here, where they would copy all these expressions
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), "n_lines", "n_other", "n_distinct", F.monotonically_increasing_id().alias("row_order"))


def with_votes(m: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumns({f"v_{k}": v for k, v in rules().items()})


#: Ways of being bad, and the rules that should see each; a good document is class 0.
CLASSES = ((), ("length",), ("repeats", "lines", "variety"), ("symbols", "letters"), ("word_length",))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, prior: float = 0.85, accuracy: float = 0.8) -> list[tuple[float, list[dict[int, float]]]]:
    """Expectation-maximisation over counted vote patterns; for each class, log share and log chances of each rule's votes.

    Bad documents fail in different ways: a document full of symbols does not repeat itself. So there is a latent class
    for each way, in which its own rules are accurate and the others vote as on good documents; one class for all would
    let rules that see nothing outvote the one that does. To abstain is no evidence. EM starts from, and is held by a fiftieth of all documents'
    weight of, the belief that most documents are good and rules mostly right; this fixes which class is which.
    """
    names = list(rules())
    total = sum(n for _, n in patterns)
    weight = 50 + 0.02 * total

    def belief(k: int, own: tuple[str, ...]) -> dict[int, float]:
        bad = accuracy if names[k] in own else (1 - accuracy) / len(names)
        return {-1: bad, 1: 1 - bad}

    first = [[belief(k, own) for k in range(len(names))] for own in CLASSES]
    begin = [prior] + [(1 - prior) / (len(CLASSES) - 1)] * (len(CLASSES) - 1)
    share, table = begin, first
    for _ in range(rounds):
        mass = [x * weight for x in begin]
        votes = [[{v: m * x for v, x in t.items()} for t in tables] for m, tables in zip(mass, first, strict=True)]
        for p, n in patterns:
            like = [math.log(s) + sum(math.log(t[v]) for t, v in zip(tables, p, strict=True) if v) for s, tables in zip(share, table, strict=True)]
            top = max(like)
            parts = [math.exp(x - top) for x in like]
            whole = sum(parts)
            for c, x in enumerate(parts):
                mass[c] += n * x / whole
                for t, v in zip(votes[c], p, strict=True):
                    if v:
                        t[v] += n * x / whole
        share = [m / sum(mass) for m in mass]
        table = [[{v: x / sum(t.values()) for v, x in t.items()} for t in tables] for tables in votes]
    return [(math.log(s), [{v: math.log(x) for v, x in t.items()} for t in tables]) for s, tables in zip(share, table, strict=True)]


def posterior(model: list[tuple[float, list[dict[int, float]]]]) -> Column:
    """The probability of being good, from the vote columns."""

    def score(share: float, tables: list[dict[int, float]]) -> Column:
        total = F.lit(share)
        for k, t in zip(rules(), tables, strict=True):
            total = total + F.when(F.col(f"v_{k}") == 1, F.lit(t[1])).when(F.col(f"v_{k}") == -1, F.lit(t[-1])).otherwise(F.lit(0.0))
        return total

    good, *bad = [score(*c) for c in model]
    return 1 / (1 + sum((F.exp(b - good) for b in bad), F.lit(0.0)))


def judge(spark: SparkSession, voted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """voted: with base_failed and the votes. Adds p_good and kept. Bounded: the driver gets at most 3 ** rules counts."""
    names = [f"v_{k}" for k in rules()]
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().collect()]
    p = F.round(posterior(estimate(sorted(patterns))), 9)
    return voted.withColumn("p_good", p).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def good_rows(spark: SparkSession, docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows of docs, in these columns, that are kept. Measures are taken twice, to count votes and to decide: a row
    travels with its measures, and no copy of the texts is written. Every row is judged for itself, whatever its id."""
    rows = docs.select(F.struct(*columns).alias("row"), "text")
    voted = judge(spark, with_votes(measures(rows, id_col="row")))
    return voted.filter(F.col("kept") & (F.col("row_order") >= 0)).select("doc_id.*")


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    voted = saved(spark, with_votes(measures(docs)), "votes")
    return judge(spark, voted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
