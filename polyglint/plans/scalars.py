"""Small queries: predicates, multisets, plural groups, dimensions. Imported for its registrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import text as X
from ..operators import checks as C
from ..operators import model as M
from ..operators import relational as R
from .registry import REQ, _rel, _table, _with_findings, query



@query("f13_language", "SELECT key, lower(regexp_extract(locale || '-DE', '^([^-_]*)', 1)) AS lang FROM _fmt")
def f13(spark, d):
    return _rel(spark, d, "fmt").select("key", X.language(F.concat("locale", F.lit("-DE"))).alias("lang"))


@query("f14_latin_letters", "SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[A-Za-zÀ-ɏ]', '', 'g')) AS INT) AS latin, CAST(length(text) - length(regexp_replace(text, '\\p{L}', '', 'g')) AS INT) AS letters FROM documents")
def f14(spark, d):
    t = F.col("text")
    return _table(spark, d, "documents").select("doc_id", X.latin_letters(t).alias("latin"), X.letters(t).alias("letters"))


@query("f9_required_categories", f"SELECT * FROM (VALUES {REQ}) t(lang, category)")
def f9(spark, d):
    return dims.required_categories(spark)


@query("f17_inflections", """SELECT a, b FROM (SELECT a, b, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda k: substr(a, 1, k) = substr(b, 1, k))) AS c FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_type, ' ', 1) || 'e' AS b FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1), split_part(p_name, ' ', 1) || 's' FROM part))
    WHERE c >= 3 AND c + 2 >= least(length(a), length(b)) AND abs(length(a) - length(b)) <= 2""")
def f17(spark, d):
    p = _table(spark, d, "part")
    first = F.split("p_name", " ")[0]
    pairs = p.select(first.alias("a"), F.concat(F.split("p_type", " ")[0], F.lit("e")).alias("b")).union(p.select(first, F.concat(first, F.lit("s")))).distinct()
    return pairs.filter(X.inflection(F.col("a"), F.col("b")))


@query("p9_locales", "SELECT tag, regexp_matches(tag, '^[a-z]{2,3}([-_]([A-Z][a-z]{3}|[A-Z]{2}|[0-9]{3})){0,2}$') AS ok FROM (SELECT DISTINCT lang || CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '-BR' WHEN 2 THEN '_Latn' WHEN 3 THEN '-night' WHEN 4 THEN '-419' ELSE '-Latn-RS-x' END AS tag FROM documents)")
def p9(spark, d):
    m = F.col("doc_id") % 6
    tag = F.concat("lang", F.when(m == 0, "").when(m == 1, "-BR").when(m == 2, "_Latn").when(m == 3, "-night").when(m == 4, "-419").otherwise("-Latn-RS-x"))
    return _table(spark, d, "documents").select(tag.alias("tag")).distinct().select("tag", X.is_locale(F.col("tag")).alias("ok"))


@query("p15_keylike_sources", "SELECT user_id, event_id FROM events WHERE event_type || CASE WHEN event_id % 2 = 0 THEN '.' ELSE ' ' END || CAST(user_id AS VARCHAR) LIKE '%.%' AND event_id % 3 <> 0")
def p15(spark, d):
    s = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, ".").otherwise(" "), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "://").otherwise(""))
    return _table(spark, d, "events").filter(X.is_key(s)).select("user_id", "event_id")


@query("p14_templates", "SELECT DISTINCT lang, 'res/values-' || lang || '-rBR/strings.xml' AS android, 'i18n/' || lang || '-BR.json' AS json FROM documents")
def p14(spark, d):
    from ..sources.catalog import expanded

    tag = F.concat("lang", F.lit("-BR"))
    return _table(spark, d, "documents").select("lang", expanded(F.lit("res/values-{android_locale}/strings.xml"), tag).alias("android"), expanded(F.lit("i18n/{locale}.json"), tag).alias("json")).distinct()


@query("p17_touched_catalogs", "SELECT path FROM (SELECT DISTINCT 'src/' || CAST(p_size AS VARCHAR) || CASE p_partkey % 5 WHEN 0 THEN '.json' WHEN 1 THEN '.po' WHEN 2 THEN '.rs' WHEN 3 THEN '.strings' ELSE '.md' END AS path FROM part) WHERE regexp_matches(path, '[.](json|po|strings)$')")
def p17(spark, d):
    from ..sources.catalog import format_of

    m = F.col("p_partkey") % 5
    paths = _table(spark, d, "part").select(F.concat(F.lit("src/"), F.col("p_size").cast("string"), F.when(m == 0, ".json").when(m == 1, ".po").when(m == 2, ".rs").when(m == 3, ".strings").otherwise(".md")).alias("path")).distinct()
    return paths.filter(format_of(F.col("path")).isNotNull())


@query("a11_tag_counts", """SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<(/?[A-Za-z][A-Za-z0-9:_-]*)[^<>]*>', 1))) AS tag FROM pages) GROUP BY ALL""")
def a11(spark, d):
    return _table(spark, d, "pages").select("page_id", F.explode(X.tags(F.col("html"))).alias("tag")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


FLAT = r"'%[0-9]+\$[a-zA-Z@]|\{\{ *[A-Za-z0-9_.-]+ *\}\}|\{[A-Za-z0-9_.-]+\}'"


@query("a10_placeholder_counts", f"SELECT key, token, count(*) AS n FROM (SELECT key, unnest(regexp_extract_all(translation, {FLAT})) AS token FROM _fmt) GROUP BY ALL")
def a10(spark, d):
    return R.placeholder_counts(_rel(spark, d, "fmt"), "translation")


@query("o7_lost_placeholders", f"SELECT key, token, CAST(a - b AS BIGINT) AS lost FROM (SELECT key, token, sum(s) AS a, sum(t) AS b FROM (SELECT key, unnest(regexp_extract_all(source, {FLAT})) AS token, 1 AS s, 0 AS t FROM _fmt UNION ALL SELECT key, unnest(regexp_extract_all(translation, {FLAT})), 0, 1 FROM _fmt) GROUP BY ALL) WHERE a > b")
def o7(spark, d):
    return R.lost_placeholders(_rel(spark, d, "fmt"))


@query("o8_lost_links", r"SELECT key, regexp_extract(source, 'https://[a-z0-9./]+[a-z0-9]') AS link FROM (SELECT p_partkey AS key, 'see https://a.example.com/' || CAST(p_size AS VARCHAR) || '.' AS source, p_partkey % 3 AS m FROM part) WHERE m <> 1")
def o8(spark, d):
    """Kept, changed and dropped links."""
    m = F.col("p_partkey") % 3
    s = F.concat(F.lit("see https://a.example.com/"), F.col("p_size").cast("string"), F.lit("."))
    t = F.when(m == 0, F.lit("siehe oben")).when(m == 1, F.concat(F.lit("siehe "), s)).otherwise(F.concat(F.lit("siehe https://b.example.com/"), F.col("p_size").cast("string")))
    return _table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.explode(X.lost_links(s, t)).alias("link"))


@query("a7_plural_groups", "SELECT base, n FROM (SELECT 'k' || CAST(c_custkey % 90 AS VARCHAR) AS base, count(DISTINCT c_custkey % 7) AS n, bool_or(c_custkey % 7 = 0) AS other FROM customer WHERE c_custkey % 7 < 3 GROUP BY 1) WHERE other AND n > 1")
def a7(spark, d):
    m = F.col("c_custkey") % 7
    keys = _table(spark, d, "customer").filter(m < 3).select(F.concat(F.lit("k"), (F.col("c_custkey") % 90).cast("string"), F.when(m == 0, "_other").when(m == 1, "_one").otherwise("_few")).alias("key"))
    return R.plural_groups(keys)


@query("o3_category_order", "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'other' WHEN 1 THEN 'zero' WHEN 2 THEN 'many' WHEN 3 THEN 'one' WHEN 4 THEN 'few' WHEN 5 THEN 'two' ELSE '=1' END AS category, CASE p_partkey % 7 WHEN 0 THEN 5 WHEN 1 THEN 0 WHEN 2 THEN 4 WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 6 END AS rank FROM part")
def o3(spark, d):
    m = F.col("p_partkey") % 7
    category = F.when(m == 0, "other").when(m == 1, "zero").when(m == 2, "many").when(m == 3, "one").when(m == 4, "few").when(m == 5, "two").otherwise("=1")
    return R.in_category_order(_table(spark, d, "part").select(F.col("p_partkey").alias("id"), category.alias("category")))


_with_findings(
    "a14_fixable_keys",
    "SELECT DISTINCT locale, key FROM a WHERE code = 'length'",
    lambda a, b: C.fixable(a.withColumn("severity", F.lit("error")).withColumn("fix", F.lit(None).cast("string"))),
)
_with_findings("a4_retained", "SELECT code, count(*) AS n FROM a WHERE locale <> 'ja' GROUP BY code", lambda a, b: R.retained(a, ["de", "fr", "pl"]).groupBy("code").agg(F.count(F.lit(1)).alias("n")))


@query("m5_flagged_verdicts", "SELECT doc_id, quality + toxic AS score FROM labels WHERE quality + toxic <= 1")
def m5(spark, d):
    return M.flagged_verdicts(_table(spark, d, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("score")), 1)


@query("m2_prompts", "SELECT key, 'Translate into ' || locale || ': ' || source || chr(10) || 'As in: a → b; c → d' AS prompt FROM _fmt")
def m2(spark, d):
    rows = _rel(spark, d, "fmt").select("key", "locale", "source", F.lit(None).cast("string").alias("comment"), F.array(F.lit("a → b"), F.lit("c → d")).alias("examples"))
    return M.prompts(rows).select("key", "prompt")


@query("t10_forgotten", "SELECT doc_id FROM documents WHERE lang <> 'de'")
def t10(spark, d):
    return R.forget(_table(spark, d, "documents").withColumnRenamed("lang", "locale"), "de").select("doc_id")


@query("s22_admissible_events", "SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0 AND role <> 'assistant'")
def s22(spark, d):
    from ..streaming.limiter import only_requests

    c = _table(spark, d, "conversations")
    action = F.when(F.col("turn") % 2 == 0, "opened").otherwise("closed")
    body = F.to_json(F.struct(action.alias("action"), F.struct(F.col("turn").alias("number"), (F.col("role") == "assistant").alias("draft")).alias("pull_request"), F.struct(F.col("conv_id").alias("id")).alias("installation")))
    return only_requests(c.select(body.alias("value"))).select(F.col("installation").alias("conv_id"), F.col("number").alias("turn"))
