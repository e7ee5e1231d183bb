r"""Personal data: patterns, and information-theoretic sanitisation of the terms that give them away: op3.
DataFrame operations only.

Base spans come from four patterns. The values they find are protected entities. For each entity e and each term t in
the same document, outside the spans, the corpus gives n(e), n(t) and n(t, e) over documents, and how strongly t reveals
e: PMI(t; e) / IC(e) = 1 + log p(e | t) / IC(e), which is 1 where t occurs only with e. Terms at or over the disclosure
threshold become spans wherever they stand outside an address, also in documents without the entity: `term` (to be
generalised), or `reveal` (to be removed) at or over the removal threshold. clean_texts() does both.

Copies are no evidence: of the places where t meets e, half at least must have different neighbours. Little support
lowers the estimate: p(e | t) counts as though t stood in min_contexts contexts at least, those not seen being without e.

Entities that stand in the same texts have the same counts with every term and are rated as one: a list of contacts that
stand nowhere else is one entity to its terms. Texts are never shuffled for the corpus counts: words that may reveal
something are looked up in a broadcast list, and what moves is ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, inputs, saved

# Kinds in the order of the contract. The patterns are the contract's; a start is only tried where a run
# begins or the last match ended, and repetitions are possessive where nothing could be given back, so that long runs
# take linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: A word of 3 to 64 letters; longer runs are no terms.
TERM = r"(?<![\p{L}\p{M}])\p{L}[\p{L}\p{M}]{2,63}+(?![\p{L}\p{M}])"
#: Rows of a table that may be broadcast: ids and terms of at most 64 letters.
MOST = 100_000
SPAN = "array<struct<s:int,e:int,v:string>>"
#: Kinds of spans that the method adds, in the order in which they are listed.
EXTRA = ("term", "reveal")
MARKS = "array<struct<kind:string,s:int,e:int>>"


def _passes(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, r"[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda x: x.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def located(text: Column, pattern: str, wanted: Callable[[Column], Column] = lambda v: v.isNotNull()) -> Column:
    """Matches, leftmost and non-overlapping, with start and end in code points: what stands between matches and the
    matches themselves alternate, and their lengths add up to places. Of all matches, only wanted ones are returned."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    pairs = F.zip_with(between, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda n, v: F.struct(n.alias("n"), v.alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, p: Column) -> Column:
        s, e = a["at"] + p["n"], a["at"] + p["n"] + F.coalesce(F.char_length(p["v"]), F.lit(0))
        return F.struct(e.alias("at"), F.when(p["v"].isNotNull() & wanted(p["v"]), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), p["v"].alias("v"))))).otherwise(a["out"]).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and, for each kind, an array of (s, e, v). Null or empty text: none."""
    t = inputs(docs, id_col, text_col).withColumn("text_key", F.md5("text"))
    none = F.array().cast(SPAN)
    for k in KINDS:
        t = t.withColumn(k, F.when(F.col("text").rlike(NEEDS[k]), _passing(k)).otherwise(none))
    return t


def _passing(kind: str) -> Column:
    return F.filter(located(F.col("text"), PATTERNS[kind]), lambda x: _passes(kind, x["v"]))


def _values(kind: str) -> Column:
    return F.transform(kind, lambda x: F.concat(F.lit(f"{kind}:"), F.lower(x["v"])))


def _named(kind: str) -> Column:
    return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def _words(text: Column) -> Column:
    """Terms of a text outside its addresses, lower-cased; the other kinds of spans hold no letters."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, PATTERNS["email"], "\n")), F.lit(TERM), F.lit(0))


def _entities(one: DataFrame, n_docs: int) -> DataFrame:
    """entity, n_entity (documents), ic and class: entities of the same texts share the class."""
    each = one.select("copies", F.xxhash64("text_key").alias("h"), F.explode("entities").alias("entity"))
    texts = [F.count(F.lit(1)), F.sum(F.col("h").bitwiseAND(F.lit((1 << 40) - 1))), F.bit_xor("h")]
    found = each.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.xxhash64(*texts).alias("class"))
    return found.withColumn("ic", F.greatest(F.log2(F.lit(float(n_docs)) / F.col("n_entity")), F.lit(1e-9))).filter("ic > 1")


def revealing_terms(spark: SparkSession, docs: DataFrame, found: DataFrame, disclosure: float, removal: float, min_contexts: int) -> tuple[DataFrame, DataFrame] | None:
    """term, kind; and doc_id, text_key, term wherever in the corpus one of them stands. None if there are none.
    found: text_key, entities and text of documents that have an entity. docs: doc_id, text_key, text.

    Every entity is paired with the terms of its texts, however few they are: fewer than min_contexts contexts only lower
    the estimate of p(e | t). A term of too many documents for an entity's count is left out before it is paired, as it
    can't reach the threshold. All that is counted is combined before it is shuffled.
    """
    one = found.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"), F.first("entities").alias("entities"))
    one = saved(spark, one.select("text_key", "copies", "entities", _words(F.col("text")).alias("words")), "held")
    ents = _entities(one, docs.count())
    # share >= disclosure needs n_term <= n_entity * 2 ** ((1 - disclosure) * ic)
    ents = saved(spark, ents.withColumn("most", F.col("n_entity") * F.pow(F.lit(2.0), (1 - disclosure) * F.col("ic")) + 1e-6), "entities")
    if ents.isEmpty():
        return None
    classes = ents.groupBy("class").agg(F.first("n_entity").alias("n_entity"), F.first("ic").alias("ic"), F.first("most").alias("most"))
    held = one.select("text_key", F.explode("entities").alias("entity")).join(_small(ents.select("entity", "class", "most")), "entity").select("text_key", "class", "most").distinct()
    held = saved(spark, held, "classes")
    there = one.select("copies", F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.sum("copies").alias("n_term"))
    there = saved(spark, there.filter(F.col("n_term") <= ents.agg(F.max("most")).first()[0]), "there")
    limits = held.groupBy("text_key").agg(F.max("most").alias("limit"))
    around = F.transform("words", lambda w, i: F.struct(w.alias("term"), F.xxhash64(F.get("words", i - 1), F.get("words", i + 1)).alias("around")))
    places = one.select("text_key", "copies", F.explode(around).alias("t")).select("text_key", "copies", "t.*").join(_small(there), "term")
    places = places.join(_small(limits), "text_key").filter("n_term <= limit").select("text_key", "copies", "term", "around", "n_term").distinct()
    meets = places.join(held, "text_key").filter("n_term <= most")
    meets = saved(spark, meets.select("class", "term", "around", "text_key", "copies"), "meets")
    contexts = meets.select("class", "term", "around").distinct().groupBy("class", "term").agg(F.count(F.lit(1)).alias("n_contexts"))
    both = meets.select("class", "term", "text_key", "copies").distinct().groupBy("class", "term").agg(F.sum("copies").alias("n_both"))
    both = both.join(contexts, ["class", "term"])
    pairs = both.filter(2 * F.col("n_contexts") >= F.col("n_both")).join(classes, "class")
    support = F.least(F.col("n_contexts") / float(min_contexts), F.lit(1.0))

    def rate(pairs: DataFrame, n_term: DataFrame) -> DataFrame:
        share = 1 + F.log2(support * F.least(F.col("n_both") / F.col("n_term"), F.lit(1.0))) / F.col("ic")
        return pairs.join(n_term, "term").withColumn("share", share).filter(F.col("share") >= disclosure)

    # a term stands in as many documents at least as it does in those with an entity: what fails by that count alone, as
    # common words do, isn't looked up in the corpus
    pairs = saved(spark, rate(pairs, there).drop("n_term", "share"), "pairs")
    terms = saved(spark, pairs.select("term").distinct(), "candidates")
    if terms.isEmpty():
        return None
    n_term = _where(docs).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(_small(terms), "term", "left_semi")
    out = rate(pairs, n_term).groupBy("term").agg(F.when(F.max("share") >= removal, "reveal").otherwise("term").alias("kind"))
    out = saved(spark, out, "terms")
    dropped(spark, one, ents, held, there, meets, pairs, terms, shuffles=False)
    if out.isEmpty():
        return None
    return out, saved(spark, _where(docs).join(_small(out.select("term")), "term", "left_semi"), "hits")


def _where(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, term: a row for each term of each document."""
    return docs.select("doc_id", "text_key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))


def _small(df: DataFrame) -> DataFrame:
    """To be broadcast if it has MOST rows at most, which is checked. For tables that are saved or cheap to count."""
    return F.broadcast(df) if df.count() <= MOST else df


def sanitise(spark: SparkSession, docs: DataFrame, disclosure: float = 0.9, removal: float = 0.97, min_contexts: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, the arrays of base_spans without texts, and extra: an array of (kind, s, e) of revealing terms,
    by kind as in EXTRA, then start.

    Rows that are equal in id and text get equal spans; an empty table gives no rows.
    """
    texts = inputs(docs, id_col, text_col).withColumn("text_key", F.md5("text"))
    based = base_spans(docs, id_col, text_col)
    any_ = sum((F.size(k) for k in KINDS), F.lit(0)) > 0
    entities = F.array_distinct(F.concat(*[_values(k) for k in KINDS]))
    based = saved(spark, based.select("doc_id", "text_key", *KINDS, F.when(any_, entities).alias("entities"), F.when(any_, F.col("text")).alias("text")), "spans")
    found = based.filter(F.col("entities").isNotNull()).select("entities", "text", "text_key")
    told = revealing_terms(spark, texts, found, disclosure, removal, min_contexts)
    based, none = based.drop("text", "entities"), F.array().cast(MARKS)
    if told is None:
        return based.withColumn("extra", none)
    terms, hits = told
    # each kind's terms as a column of a saved table: an expression would be evaluated again for every word
    own = hits.join(_small(terms), "term").groupBy("doc_id", "text_key").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("term"))).alias(k) for k in EXTRA])
    own = saved(spark, own, "own-terms")
    at = texts.alias("w").join(_small(own).alias("h"), F.expr("w.doc_id <=> h.doc_id AND w.text_key = h.text_key")).select("w.doc_id", "w.text_key", "text", *EXTRA)
    marks = []
    for k in EXTRA:
        spans = located(F.col("text"), TERM, lambda v: F.array_contains(k, F.lower(v)))  # noqa: B023
        marks.append(F.when(F.size(k) > 0, F.transform(spans, lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))).otherwise(none))  # noqa: B023
    extra = at.select("doc_id", "text_key", F.concat(*marks).alias("extra")).dropDuplicates(["doc_id", "text_key"])
    joined = based.alias("b").join(extra.alias("x"), F.expr("b.doc_id <=> x.doc_id AND b.text_key = x.text_key"), "left")
    outside = F.filter("extra", lambda x: ~F.exists("email", lambda m: (m["s"] < x["e"]) & (x["s"] < m["e"])))
    return joined.select("b.*", "extra").withColumn("extra", F.when(F.col("extra").isNull(), none).otherwise(outside))


def clean_texts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """doc_id, text: base spans and `reveal` terms are removed, which leaves <kind> and nothing, and `term` ones become
    <term>. Of overlapping spans the first in the text stands, the longest of equal starts. Null text: empty."""
    texts = inputs(docs, id_col, text_col)
    spans = sanitise(spark, docs, id_col=id_col, text_col=text_col, **options).dropDuplicates(["doc_id", "text_key"])
    base = F.concat(*[F.transform(k, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("z"), F.lit(f"<{k}>").alias("by"))) for k in KINDS])  # noqa: B023
    more = F.transform("extra", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("z"), F.when(x["kind"] == "term", "<term>").otherwise("").alias("by")))
    spans = spans.select("doc_id", "text_key", F.array_sort(F.concat(base, more)).alias("spans"))
    at = texts.alias("t").join(spans.alias("s"), F.expr("t.doc_id <=> s.doc_id AND md5(t.text) = s.text_key")).select("t.doc_id", "text", "spans")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        part = F.array(F.substr(F.col("text"), a["at"] + 1, x["s"] - a["at"]), x["by"])
        return F.when(x["s"] < a["at"], a).otherwise(F.struct((-x["z"]).alias("at"), F.concat(a["out"], part).alias("out")))

    end = lambda a: F.concat(F.array_join(a["out"], ""), F.substr(F.col("text"), a["at"] + 1))
    return at.select("doc_id", F.when(F.size("spans") > 0, F.aggregate("spans", start, step, end)).otherwise(F.col("text")).alias("text"))


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    r = sanitise(spark, docs)
    base = F.concat(*[_named(k) for k in KINDS])
    extra = F.transform("extra", lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string")))
    return r.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, extra), ",").alias("spans"),
    )
