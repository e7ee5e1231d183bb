"""Catalog-shaped relations over the driver's tables, as SQL that both engines read the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Each entry: SQL over the named tables. CTE bodies of other relations may be named in braces with a leading _.
U_FMT = """
SELECT 'part.' || CAST(p_partkey AS STRING) AS key,
       CASE p_partkey % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' WHEN 2 THEN 'pl' ELSE 'ja' END AS locale,
       '%1$s ' || p_name || ' {{count}}' AS source,
       CASE CAST(floor(p_partkey / 4) AS BIGINT) % 16
         WHEN 0 THEN '%1$s ' || p_name || ' {{count}}'
         WHEN 1 THEN p_name || ' {{count}}'
         WHEN 2 THEN '%1$d ' || p_name || 'x {{count}}'
         WHEN 3 THEN '%1$s ' || p_name || 'x {{anzahl}}'
         WHEN 4 THEN '%1$s ' || p_name || 'x {count}'
         WHEN 5 THEN '%1$s {{count}} ' || p_name || 'x {{count}}'
         WHEN 6 THEN '%1$s <b>' || p_name || '</b> {{count}}'
         WHEN 7 THEN ' %1$s ' || p_name || ' {{count}} '
         WHEN 8 THEN '  '
         WHEN 9 THEN '%1$s ' || p_name || ' CafÃ©x {{count}}'
         WHEN 10 THEN '%1$s ' || p_name || 'x ( {{count}}'
         WHEN 11 THEN '%1$s ' || p_name || 'x &amp;amp; {{count}}'
         WHEN 12 THEN '%1$s ' || p_name || ' https://shop.example.com/a {{count}}'
         WHEN 13 THEN '%1$s ' || p_name || repeat(' und noch mehr', 9) || ' {{count}}'
         WHEN 14 THEN '%1$s ' || p_name || 'x {{count}} me@shop.example.com.'
         ELSE '{{count}} ' || p_name || 'x %1$s' END AS translation
FROM {part}
"""
U_CONV = """
SELECT CAST(u.conv_id AS STRING) || '.' || CAST(u.turn AS STRING) AS key, 'ja' AS locale, u.text AS source,
       CASE WHEN u.conv_id % 2 = 0 THEN regexp_replace(a.text, '[.!?]+$', '') ELSE a.text END AS translation
FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'
"""
U_PAGES = """
SELECT CAST(page_id AS STRING) AS key, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS locale,
       regexp_extract(html, '<title>([^<]*)</title>', 1) AS source,
       CASE page_id % 5 WHEN 0 THEN replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&amp;amp;') || ' &amp;lt;'
         WHEN 1 THEN '<i>' || regexp_extract(html, '<h1>([^<]*)</h1>', 1) || '</i>' ELSE regexp_extract(html, '<h1>([^<]*)</h1>', 1) END AS translation
FROM {pages}
"""
LOCKED = """
SELECT 'doc.' || CAST(doc_id AS STRING) AS key, lang AS locale, text AS source,
       CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN NULL ELSE substr(text, 11) END AS translation, doc_id
FROM {documents}
"""
LINES = {
    "spark": "SELECT doc_id, CAST(pos + 1 AS BIGINT) AS line, text FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (pos, text) FROM {documents})",
    "duckdb": "SELECT doc_id, line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line FROM {documents})",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Temporary views only name the inputs while the statement is analysed."""
    for t in TABLES:
        if "{" + t + "}" in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"polyglint_{t}")
            sql = sql.replace("{" + t + "}", f"polyglint_{t}")
    return spark.sql(sql)


def plain(sql: str) -> str:
    """The same relation for an engine that has the tables as views."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
