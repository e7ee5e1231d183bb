"""More queries: project rules, locators, extraction, reports. Imported for its registrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import text as X
from ..operators import project as J
from ..operators import relational as R
from ..operators import render
from . import registry as G
from .registry import _findings, _rel, _status, _table, query

NOTES = """notes AS (SELECT 'part.' || CAST(p_partkey AS VARCHAR) AS key, 'de' AS locale, p_name AS translation, CASE p_partkey % 6 WHEN 0 THEN 'x, tool:skip' WHEN 1 THEN 'tool:max=8' WHEN 2 THEN 'tool:ignore=length,markup' WHEN 3 THEN 'plain' END AS comment FROM part)"""


def _notes(spark, d):
    m = F.col("p_partkey") % 6
    return _table(spark, d, "part").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("key"), F.lit("de").alias("locale"), F.col("p_name").alias("translation"), F.when(m == 0, "x, tool:skip").when(m == 1, "tool:max=8").when(m == 2, "tool:ignore=length,markup").when(m == 3, "plain").alias("comment"))


@query("p5_unskipped", f"WITH {NOTES} SELECT key FROM notes WHERE NOT coalesce(regexp_matches(comment, '(^|[\\s,])tool:skip($|[\\s,])'), false) AND NOT regexp_matches(key, '^part\\..*7$')")
def p5(spark, d):
    return J.unskipped(_notes(spark, d), ["part.*7"], "tool").select("key")


@query("p4_limits", f"WITH {NOTES} SELECT key, locale, 'length' AS code, 'error' AS severity FROM notes WHERE length(translation) > TRY_CAST(regexp_extract(comment, 'tool:max=([0-9]+)', 1) AS INT)")
def p4(spark, d):
    return J.too_long(_notes(spark, d), "tool")


@query("p6_unignored", f"WITH {NOTES} SELECT key, c AS code FROM notes, (VALUES ('length'), ('markup'), ('empty')) v(c) WHERE NOT (coalesce(comment, '') LIKE '%tool:ignore%' AND c IN ('length', 'markup')) AND NOT (c = 'empty' AND regexp_matches(key, '^part\\.1.*$'))")
def p6(spark, d):
    n = _notes(spark, d)
    f = n.select("key", F.explode(F.array(F.lit("length"), F.lit("markup"), F.lit("empty"))).alias("code"))
    return J.unignored(f, n, {"empty": ["part.1*"]}, "tool").select("key", "code")


@query("s16_template_locales", "SELECT 'app/' || lang || '_' || CAST(doc_id % 9 AS VARCHAR) || '/x.json' AS path, lang || '_' || CAST(doc_id % 9 AS VARCHAR) AS locale FROM documents WHERE doc_id % 2 = 0")
def s16(spark, d):
    paths = _table(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "app/").otherwise("lib/"), "lang", F.lit("_"), (F.col("doc_id") % 9).cast("string"), F.lit("/x.json")).alias("path"))
    return J.template_locales(paths, "app/{locale}/x.json")


@query("p13_source_pick", "SELECT source AS path, arg_min(lang, CASE WHEN lang = 'es' THEN 0 WHEN lang = 'en' THEN 1 ELSE 3 END) AS source_locale FROM documents GROUP BY source")
def p13(spark, d):
    return J.source_pick(_table(spark, d, "documents").select(F.col("source").alias("path"), F.col("lang").alias("locale")).distinct(), "es")


@query("c2_unlisted_locales", "SELECT DISTINCT lang AS locale FROM documents WHERE lang NOT IN ('en', 'de')")
def c2(spark, d):
    return J.unlisted(_table(spark, d, "documents").select(F.col("lang").alias("locale")).distinct(), ["de"], "en")


@query(
    "j11_located",
    """WITH k AS (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS file, 'a.' || CAST(l_partkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS key, CAST(l_orderkey AS INT) AS line FROM lineitem),
    f AS (SELECT CAST(p_size % 5 AS VARCHAR) AS file, 'a.' || CAST(p_partkey AS VARCHAR) || '.' || CAST(p_size % 9 AS VARCHAR) AS key FROM part)
    SELECT f.file, f.key, coalesce(e.line, n.near) AS line FROM f LEFT JOIN (SELECT file, key, min(line) AS line FROM k GROUP BY ALL) e ON e.file = f.file AND e.key = f.key
    LEFT JOIN (SELECT file, split_part(key, '.', 3) AS seg, min(line) AS near FROM k GROUP BY ALL) n ON n.file = f.file AND n.seg = split_part(f.key, '.', 3)""",
)
def j11(spark, d):
    s = lambda c: F.col(c).cast("string")
    k = _table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).cast("string").alias("file"), F.concat(F.lit("a."), s("l_partkey"), F.lit("."), s("l_linenumber")).alias("key"), F.col("l_orderkey").cast("int").alias("line"))
    f = _table(spark, d, "part").select((F.col("p_size") % 5).cast("string").alias("file"), F.concat(F.lit("a."), s("p_partkey"), F.lit("."), (F.col("p_size") % 9).cast("string")).alias("key"))
    return J.located(f, k).select("file", "key", "line")


@query(
    "j11_nested_lines",
    """SELECT file, key, locale, line FROM (SELECT doc_id AS file, last_value(CASE WHEN line % 4 = 1 THEN 'k' || CAST(line AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS key,
    CASE WHEN line % 4 <> 1 THEN 'l' || CAST(line % 4 AS VARCHAR) END AS locale, line FROM _lines) WHERE locale IS NOT NULL""",
)
def j11n(spark, d):
    m = F.col("line") % 4
    rows = _rel(spark, d, "lines").select(F.col("doc_id").alias("file"), "line", F.when(m == 1, F.concat(F.lit("k"), F.col("line").cast("string"))).alias("key"), F.when(m != 1, F.concat(F.lit("l"), m.cast("string"))).alias("locale"))
    return J.nested_lines(rows)


SUFFIX = "'k' || CAST({0} % 60 AS VARCHAR) || '_' || CASE {0} % {1} WHEN 0 THEN 'one' WHEN 1 THEN 'other' WHEN 2 THEN 'few' ELSE 'zero' END"


def _suffixed(c, n):
    return F.concat(F.lit("k"), (c % 60).cast("string"), F.lit("_"), F.when(c % n == 0, "one").when(c % n == 1, "other").when(c % n == 2, "few").otherwise("zero")).alias("key")


@query(
    "j15_plural_group_gaps",
    f"""WITH s AS (SELECT DISTINCT {SUFFIX.format("c_custkey", 7)} AS key FROM customer), t AS (SELECT DISTINCT {SUFFIX.format("p_partkey", 11)} AS key FROM part),
    g AS (SELECT split_part(key, '_', 1) AS base FROM s GROUP BY 1 HAVING bool_or(key LIKE '%other') AND count(*) > 1)
    SELECT base, c AS category FROM g, (VALUES ('one'), ('few'), ('many'), ('other')) v(c) WHERE base IN (SELECT split_part(key, '_', 1) FROM t) AND base || '_' || c NOT IN (SELECT key FROM t)""",
)
def j15(spark, d):
    s = _table(spark, d, "customer").select(_suffixed(F.col("c_custkey"), 7)).distinct()
    t = _table(spark, d, "part").select(_suffixed(F.col("p_partkey"), 11)).distinct()
    return J.plural_group_gaps(s, t, ["one", "few", "many", "other"])


@query("j16_form_gaps", "SELECT DISTINCT a.key, a.variable FROM (SELECT CAST(p_partkey % 400 AS VARCHAR) AS key, p_type AS variable FROM part WHERE p_size % 2 = 0) a ANTI JOIN (SELECT CAST(p_partkey % 400 AS VARCHAR) AS key, p_type AS variable FROM part WHERE p_size % 3 = 0) b ON a.key = b.key AND a.variable = b.variable")
def j16(spark, d):
    p = _table(spark, d, "part").select((F.col("p_partkey") % 400).cast("string").alias("key"), F.col("p_type").alias("variable"), "p_size")
    return J.form_gaps(p.filter("p_size % 2 = 0"), p.filter("p_size % 3 = 0"))


BODY = r"regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '<x>', 'g')"
COPY = r"""len(regexp_extract_all(text, '\p{L}{2,}')) > 0 AND NOT regexp_matches(text, '^(https?:|[./#@])') AND NOT regexp_matches(text, '^[a-z]+([A-Z_][A-Za-z0-9_]*)+$')
    AND NOT regexp_matches(text, '^[A-Z0-9_]+$') AND NOT regexp_matches(text, '[{};=<>]')"""
EXTRACTED = rf"""x AS (SELECT page_id, 'text' AS kind, regexp_replace(regexp_replace(r, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g') AS text
      FROM (SELECT page_id, unnest(regexp_extract_all('>' || {BODY} || '<', '>([^<>]+)', 1)) AS r FROM pages)
    UNION ALL SELECT page_id, 'attribute', unnest(regexp_extract_all({BODY}, '(?:alt|title|placeholder|label|aria-label)="([^"]+)"', 1)) FROM pages),
    e AS (SELECT * FROM x WHERE {COPY})"""


@query("f26_extracted", f"WITH {EXTRACTED} SELECT page_id, kind, count(*) AS n, count(DISTINCT text) AS texts FROM e GROUP BY ALL")
def f26(spark, d):
    return J.extracted(_table(spark, d, "pages")).groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("texts"))


@query(
    "k18_catalog_keys",
    rf"""WITH {EXTRACTED}, b AS (SELECT DISTINCT text, array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')[1:4], '_') AS base FROM e)
    SELECT CASE WHEN n > 1 THEN base || '_' || substr(sha256(text), 1, 6) ELSE base END AS key, text FROM b JOIN (SELECT base, count(*) AS n FROM b GROUP BY base) USING (base)""",
)
def k18(spark, d):
    return J.catalog_keys(J.extracted(_table(spark, d, "pages")))


@query("k18_merged_catalog", "SELECT coalesce(a.key, b.key) AS key, coalesce(a.text, b.text) AS text, a.text IS NULL AS added FROM (SELECT 'k' || CAST(p_partkey AS VARCHAR) AS key, p_name AS text FROM part WHERE p_partkey % 2 = 0) a FULL JOIN (SELECT 'k' || CAST(p_partkey AS VARCHAR) AS key, p_type AS text FROM part WHERE p_partkey % 3 = 0) b ON a.key = b.key")
def k18m(spark, d):
    p = _table(spark, d, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), "p_name", "p_type", "p_partkey")
    return render.merged_catalog(p.filter("p_partkey % 2 = 0").select("key", F.col("p_name").alias("text")), p.filter("p_partkey % 3 = 0").select("key", F.col("p_type").alias("text")))


@query(
    "w10_insert_positions",
    """WITH x AS (SELECT p_brand AS file, 'k' || CAST(p_partkey AS VARCHAR) AS key, p_partkey AS o, p_partkey % 4 <> 0 AS old FROM part)
    SELECT file, key, after, before FROM (SELECT file, key, old, last_value(CASE WHEN old THEN key END IGNORE NULLS) OVER (PARTITION BY file ORDER BY o ROWS UNBOUNDED PRECEDING) AS after,
    first_value(CASE WHEN old THEN key END IGNORE NULLS) OVER (PARTITION BY file ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS before FROM x) WHERE NOT old""",
)
def w10(spark, d):
    p = _table(spark, d, "part").select(F.col("p_brand").alias("file"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_partkey").alias("ordinal"))
    return render.insert_positions(p.filter("ordinal % 4 = 0"), p.filter("ordinal % 4 <> 0"))


# ---- reports ---------------------------------------------------------------------------------------------------------

FULL = G.FOUND_SQL + ", g AS (SELECT file, CASE WHEN key NOT LIKE '%1' THEN CAST(CAST(substr(key, 6) AS INT) % 50 + 1 AS INT) END AS line, key, locale, code, 'warning' AS severity, code || ': 100%' AS message FROM a) "


def _full(spark, d):
    a = _findings(spark, d)[0]
    return a.select("file", F.when(~F.col("key").endswith("1"), F.substring("key", 6, 10).cast("int") % 50 + 1).alias("line"), "key", "locale", "code", F.lit("warning").alias("severity"), F.concat("code", F.lit(": 100%")).alias("message"))


def report(name, tail, f):
    G._QUERIES[name] = lambda spark, d: f(_full(spark, d))
    if tail:
        G._SQL[name] = FULL + tail


report("k12_json_report", """SELECT '{"file":"' || file || '",' || CASE WHEN line IS NULL THEN '' ELSE '"line":' || CAST(line AS VARCHAR) || ',' END || '"key":"' || key || '","locale":"' || locale || '","code":"' || code || '","severity":"' || severity || '","message":"' || message || '"}' AS json FROM g""", render.json_report)
report(
    "k13_sarif",
    """SELECT '{"ruleId":"' || code || '","level":"' || severity || '","message":{"text":"[' || locale || '] ' || key || ' ' || message || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || file || '"},"region":{"startLine":' || CAST(coalesce(line, 1) AS VARCHAR)
    || '}}}],"partialFingerprints":{"findingKey":"' || file || ':' || key || ':' || locale || ':' || code || '"}}' AS json FROM g""",
    render.sarif_results,
)
report(
    "k12_json_summary",
    """SELECT '{"errors":' || CAST(count(*) FILTER (severity = 'error') AS VARCHAR) || ',"warnings":' || CAST(count(*) FILTER (severity = 'warning') AS VARCHAR) || ',"checked":' || CAST((SELECT count(*) FROM g WHERE line IS NOT NULL) AS VARCHAR)
    || ',"coverage":{' || (SELECT string_agg('"' || locale || '":[' || CAST(done AS VARCHAR) || ',' || CAST(total AS VARCHAR) || ']', ',' ORDER BY locale) FROM (SELECT locale, count(line) AS done, count(*) AS total FROM g GROUP BY locale)) || '},"baseline":{"known":3,"stale":0}}' AS json FROM g""",
    lambda f: render.json_summary(f, f.groupBy("locale").agg(F.count("line").alias("done"), F.count(F.lit(1)).alias("total")), 3, 0),
)
report(
    "k13_sarif_log",
    """SELECT 1 AS part, count(*) AS n, count(*) - 1 AS commas FROM g UNION ALL SELECT 0, 1, 0 UNION ALL SELECT 2, 1, 0""",
    lambda f: render.sarif_log(f).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").startswith(",")).alias("commas")),
)
report(
    "k14_job_summary",
    """SELECT 1 AS part, place, '| ' || severity || ' | ' || code || ' | ' || locale || ' | ' || CASE WHEN length(key) > 60 THEN left(key, 59) || '…' ELSE key END || ' | ' || message || ' |' AS line FROM (SELECT *, row_number() OVER (ORDER BY file, locale, key, code) AS place FROM g) WHERE place <= 100
    UNION ALL SELECT 2, place, '| ' || locale || ' | ' || CAST(done AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ' | ' || CAST(percent AS VARCHAR) || '% |' FROM (SELECT *, row_number() OVER (ORDER BY percent, locale) AS place FROM (SELECT locale, count(line) AS done, count(*) AS total, CAST(floor(100 * count(line) / count(*)) AS BIGINT) AS percent FROM g GROUP BY locale)) WHERE place <= 10""",
    lambda f: render.job_summary(f, f.groupBy("locale").agg(F.count("line").alias("done"), F.count(F.lit(1)).alias("total"))),
)
report("k14_annotations", "SELECT '::' || severity || ' file=' || file || CASE WHEN line IS NULL THEN '' ELSE ',line=' || CAST(line AS VARCHAR) END || ',title=' || code || ' ' || locale || '::' || key || ': ' || replace(message, '%', '%25') AS line FROM g", render.annotations)
report(
    "k15_review_comments",
    "SELECT file, line, string_agg('**' || code || '** (' || locale || ') `' || key || '`: ' || message, chr(10) ORDER BY code, locale, '**' || code || '** (' || locale || ') `' || key || '`: ' || message) AS body FROM g WHERE line IS NOT NULL GROUP BY file, line ORDER BY file, line LIMIT 40",
    render.review_comments,
)
report("k11_text_report", "SELECT code, r AS at, file || ' ' || locale || ' ' || key AS line FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY file, locale, key) AS r FROM g) WHERE r <= 20 UNION ALL SELECT code, 21, '... and ' || CAST(count(*) - 20 AS VARCHAR) || ' more' FROM g GROUP BY code HAVING count(*) > 20", render.text_report)
report("j13_unsaid", "SELECT DISTINCT file, line FROM g WHERE line IS NOT NULL AND line % 2 = 1 ORDER BY ALL", lambda f: render.unsaid(f.filter("line is not null").select("file", "line").distinct(), f.filter("line % 2 = 0").select("file", "line")))
report("a12_findings_per_line", "SELECT file, line, count(*) AS n FROM g WHERE line IS NOT NULL GROUP BY ALL", R.findings_per_line)
report("o1_finding_order", "SELECT DISTINCT file, locale, key, code, dense_rank() OVER (PARTITION BY file ORDER BY locale, key, code) AS place FROM g", lambda f: R.in_report_order(f.select("file", "locale", "key", "code").distinct()))

G._with_status("k16_coverage_markdown", "SELECT '| ' || locale || ' | ' || CAST(done AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ' | ' || CAST(CAST(floor(100 * done / greatest(total, 1)) AS BIGINT) AS VARCHAR) || '% |' AS line FROM (SELECT locale, count(*) AS total, count(*) FILTER (state NOT IN ('new', 'untranslated', 'needs-review')) AS done FROM st GROUP BY ALL)", lambda s: render.coverage_markdown(R.coverage(s)))
G._with_status("k17_status_pivot", "SELECT locale, " + ", ".join(f"count(*) FILTER (state = '{s}') AS \"{s}\"" for s in dims.STATES) + " FROM st GROUP BY locale", lambda s: s.groupBy("locale").pivot("state", list(dims.STATES)).count().na.fill(0))
G._with_status(
    "m6_review_queue",
    "SELECT key, locale, state FROM st WHERE state = 'needs-review' OR (state = 'up-to-date' AND length(key) % 2 = 0)",
    lambda s: J.review_queue(s, s.select("key", "locale", F.when(F.length("key") % 2 == 0, "model").otherwise("human").alias("provider"))),
)


@query("k10_lock_lines", "SELECT '[keys.\"doc.' || CAST(doc_id AS VARCHAR) || '\"]' || chr(10) || 'source = \"' || substr(sha256(text), 1, 32) || '\"' AS line FROM documents UNION ALL SELECT '[keys.\"doc.' || CAST(doc_id AS VARCHAR) || '\".locales.' || lang || ']' || chr(10) || 'hash = \"' || substr(sha256(source), 1, 32) || '\"' FROM documents WHERE doc_id % 2 = 0")
def k10(spark, d):
    u = _table(spark, d, "documents").withColumn("key", F.concat(F.lit("doc."), F.col("doc_id").cast("string")))
    return J.lock_lines(u.select("key", X.content_hash(F.col("text")).alias("source_hash")), u.filter("doc_id % 2 = 0").select("key", F.col("lang").alias("locale"), X.content_hash(F.col("source")).alias("hash")))


@query("f28_reply_rows", "SELECT conv_id AS batch, 'k' || CAST(turn AS VARCHAR) AS key, role AS translation FROM conversations")
def f28(spark, d):
    c = _table(spark, d, "conversations")
    key = F.concat(F.lit("k"), F.col("turn").cast("string"))
    full = F.to_json(F.struct(F.array(F.struct(key.alias("key"), F.col("role").alias("translation"))).alias("translations")))
    short = F.to_json(F.create_map(key, F.col("role")))
    return J.reply_rows(c.select(F.col("conv_id").alias("batch"), F.concat(F.lit("Sure {as asked}: "), F.when(F.col("turn") % 2 == 0, full).otherwise(short), F.lit(" done {x}.")).alias("reply")))


@query("j17_verdicts", "SELECT doc_id % 5 AS batch, CAST(doc_id AS INT) AS ordinal, CASE WHEN doc_id % 3 = 0 THEN doc_id % 6 END AS score FROM documents")
def j17(spark, d):
    from ..operators import model

    docs = _table(spark, d, "documents")
    b = (F.col("doc_id") % 5).alias("batch")
    key = F.concat(F.lit("key-"), F.col("doc_id").cast("string"))
    asked = docs.select(b, F.col("doc_id").cast("int").alias("ordinal"), key.alias("key"), key.alias("source"))
    said = docs.filter("doc_id % 3 = 0").select(b, F.col("doc_id").cast("int").alias("ordinal"), F.when(F.col("doc_id") % 2 == 0, key).otherwise(F.upper(key)).alias("name"), (F.col("doc_id") % 6).alias("score"))
    return model.matched_verdicts(asked, said).select("batch", "ordinal", "score")


@query("m3_mock_translations", "SELECT key, locale, source, '⟦' || locale || '⟧ ' || source AS reply, 'accepted' AS state FROM (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS key, 'de' AS locale, p_name || ' {count}' AS source FROM part)")
def m3(spark, d):
    from ..operators import model

    p = _table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.lit("de").alias("locale"), F.concat("p_name", F.lit(" {count}")).alias("source"))
    return model.translate(spark, p).select("key", "locale", "source", "reply", "state")


@query("j19_unedited", "SELECT l.doc_id FROM labels l WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')")
def j19(spark, d):
    return R.unedited(_table(spark, d, "labels").filter("toxic = 1"), _table(spark, d, "documents").filter("source = 'src0'"), ["doc_id"]).select("doc_id")
