"""Odd and larger inputs of catalog queries: results as the twins give them, and plans that grow with their input."""

import re

import duckdb
from pyspark.sql import functions as F

from polyglint.functions import text as X
from polyglint.operators import project, relational, render
from polyglint.plans import catalogs, more, registry, scalars  # noqa: F401
from polyglint.sources import catalog, formats


def twin(root, name):
    c = duckdb.connect()
    for p in root.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    want = c.sql(registry.oracle_sql()[name])
    return want.columns, want.fetchall()


def test_snippets_of_indented_lines(spark, tmp_path):
    texts = ["  all\n    of it\n\n  indented", "\tone", "a\n  b\n c\r\n", "   \n \n", "", " é" * 150 + "\n" + "  😀" * 90, "x\n" * 20 + "  y"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns, want = twin(tmp_path, "w3_snippets")
    got = registry.queries()["w3_snippets"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_snippets_lose_their_common_indent(spark):
    lines = spark.createDataFrame([("f", 1, "  a"), ("f", 2, ""), ("f", 3, "    b"), ("f", 4, " ")], "file string, line int, text string")
    got = relational.snippets(lines, 1).orderBy("line").select("snippet").collect()
    assert [r[0] for r in got] == ["a\n", "a\n\n  b", "\nb\n", "b\n"]


def test_insert_positions_read_each_row_once(spark):
    new = spark.createDataFrame([("f", "n1", 0), ("f", "n2", 5), ("f", "n3", 9), ("g", "n4", 1)], "file string, key string, ordinal long")
    old = spark.createDataFrame([("f", "a", 3), ("f", "b", 5), ("f", "c", 5), ("f", "d", 7)], "file string, key string, ordinal long")
    out = render.insert_positions(new, old)
    got = {r.key: (r.after, r.before) for r in out.collect()}
    assert got == {"n1": (None, "a"), "n2": ("c", "d"), "n3": ("d", None), "n4": (None, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan and plan.count("specifiedwindowframe(RowFrame, unboundedpreceding") == 2


def tasks(df):
    """How many tasks its rows come from."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_files_of_one_partition_are_parsed_by_all_tasks(spark):
    files = spark.range(200).coalesce(1).select(F.format_string("f%d/x.json", "id").alias("path"), F.lit("json").alias("format"), F.lit(b'{"a": "b", "c": {"d": "e"}}').alias("content"))
    entries = catalog.scan(spark, files)
    assert tasks(entries) >= spark.sparkContext.defaultParallelism
    assert entries.count() == 400 and {(r.key, r.text, r["index"], tuple(r.flags), r.error) for r in entries.collect()} == {("a", "b", None, (), None), ("c.d", "e", None, (), None)}


def test_files_of_many_and_of_deep_entries():
    deep = formats.parse_json('{"a":' * 3000 + '"x"' + "}" * 3000)
    assert [(e.text, e.key.count("."), e.line) for e in deep] == [("x", 2999, 1)]
    many = "<root>\n" + "".join(f'<data name="k{i}"><value>é{i}</value>\n<comment>c</comment></data>\n' for i in range(3000)) + "</root>"
    e = formats.parse_resx(many)
    assert len(e) == 3000 and all(many[x.start : x.end] == x.text == f"é{i}" and x.line == 2 * i + 2 for i, x in enumerate(e))


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") + df._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas")


def test_flagged_entries_are_parsed_once(spark):
    po = '#, fuzzy\nmsgid "a"\nmsgstr "b"\n\nmsgid "c"\nmsgstr "d"\n'
    xc = '{"sourceLanguage": "en", "strings": {"k": {"extractionState": "stale", "localizations": {"de": {"stringUnit": {"state": "new", "value": "v"}}}}}}'
    files = spark.createDataFrame([("po/pl.po", "po", po.encode()), ("x.xcstrings", "xcstrings", xc.encode())], "path string, format string, content binary")
    found = catalog.flagged_findings(catalog.scan(spark, files))
    assert parses(found) == 1
    assert sorted((r.path, r.key, r.locale or "", r.code, r.severity) for r in found.collect()) == [("po/pl.po", "a", "", "fuzzy", "warning"), ("x.xcstrings", "k", "de", "state", "warning"), ("x.xcstrings", "k", "en", "state", "warning")]


def test_units_are_gathered_in_one_pass(spark):
    texts = {"en.json": '{"a": "A", "b": "", "c": "C", "a": "A2"}', "de.json": '{"a": "x", "a": "y", "b": "z", "lost": "l"}', "fr.json": '{"c": ""}', "m/en.json": '{"a": "M"}', "m/de.json": '{"b": "n"}'}
    files = spark.createDataFrame([(k, "json", v.encode()) for k, v in texts.items()], "path string, format string, content binary")
    placed = catalog.attached(catalog.scan(spark, files))
    units = catalog.units(placed, "en")
    row = lambda r: (r.file_set, r.key, r.locale, r.source, r.translation)
    want = [(".json", "a", "de", "A2", "y"), (".json", "a", "fr", "A2", None), (".json", "b", "de", "b", "z"), (".json", "b", "fr", "b", None), (".json", "c", "de", "C", None), (".json", "c", "fr", "C", None), ("m/.json", "a", "de", "M", None)]
    assert sorted(map(row, units.collect()), key=str) == sorted(want, key=str)
    plan = units._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and "ReusedExchange" in plan
    fixed = catalog.units(placed, "en", ["de", "pl"])
    assert parses(fixed) == 1
    want = [(s, k, loc, src, t if loc == "de" else None) for s, k, _, src, t in [w for w in want if w[2] == "de"] for loc in ("de", "pl")]
    assert sorted(map(row, fixed.collect()), key=str) == sorted(want, key=str)


def test_plural_units_read_their_forms_once(spark):
    xml = '<resources><plurals name="n"><item quantity="one">1</item><item quantity="other">o</item><item quantity="zero">z</item></plurals><plurals name="m"><item quantity="few">f</item><item quantity="few">g</item></plurals></resources>'
    files = spark.createDataFrame([("values/s.xml", "android", xml.encode())], "path string, format string, content binary")
    forms = catalog.scan(spark, files).select("key", "category", F.col("text").alias("source"))
    out = relational.plural_units(forms, spark.createDataFrame([("one",), ("few",)], "category string"))
    assert parses(out) == 1
    got = sorted(map(tuple, out.collect()))
    assert [g for g in got if g[0][0] == "n"] == [("n#plural.few", "o"), ("n#plural.one", "1"), ("n#plural.zero", "z")]
    assert [g[0] for g in got if g[0][0] == "m"] == ["m#plural.few", "m#plural.few", "m#plural.one"] and {g[1] for g in got if g[0] == "m#plural.few"} == {"f", "g"}


def nodes(plan):
    children = plan.children()
    return [plan] + [n for i in range(children.size()) for n in nodes(children.apply(i))]


def test_states_are_told_without_shuffling_texts(spark):
    units = spark.createDataFrame([("a", "de", "A", "x"), ("b", "de", "B", None), ("c", "fr", "C", "z"), ("d", None, "D", "")], "key string, locale string, source string, translation string")
    of = lambda c: X.content_hash(F.col(c))
    keys = units.select("key", of("source").alias("source_hash"))
    locales = units.filter("key in ('a', 'c')").select("key", "locale", of("translation").alias("hash"))
    reviews = units.filter("key = 'b'").select("key", "locale", of("source").alias("review_hash"))
    states = relational.status(units, keys, locales, reviews)
    assert states.columns == [*units.columns, "state"]
    assert {(r.key, r.translation, r.state) for r in states.collect()} == {("a", "x", "up-to-date"), ("b", None, "needs-review"), ("c", "z", "up-to-date"), ("d", "", "new")}
    joins = [n for n in nodes(states.select("key", "locale", "state")._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    assert joins and not [n for n in joins if re.search(r"\b(source|translation)#", n.output().toString())]
    told = spark.createDataFrame([("a", "de", "up-to-date"), ("b", "de", "needs-review"), ("c", None, "up-to-date"), ("d", None, "needs-review"), ("e", "de", "up-to-date")], "key string, locale string, state string")
    locks = spark.createDataFrame([("a", "de", "model"), ("a", "de", "other"), ("c", None, "model"), ("e", "de", "human"), ("b", "de", "model")], "key string, locale string, provider string")
    out = project.review_queue(told, locks)
    assert sorted(map(tuple, out.collect())) == [("a", "de", "up-to-date"), ("b", "de", "needs-review"), ("d", None, "needs-review")]
    assert len([n for n in nodes(out._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "LogicalRDD"]) == 2


def test_similar_rows_are_counted_without_shuffling_pairs(spark, monkeypatch):
    q = spark.createDataFrame([(1, "red green blue"), (2, "red green blue"), (3, "nothing shared")], "qid long, source string")
    c = spark.createDataFrame([(1, "red green blue", "x"), (2, "red green", "x"), (2, "red green", "x"), (2, "blue sky", "x"), (3, "red", ""), (4, "red", "red"), (5, None, "x")], "cid long, source string, translation string")
    want = [(q, 2, round(2 / 3 - 5 / 200, 6), r) for q in (1, 2) for r in (1, 2)] + [(q, 2, round(1 / 4 - 6 / 200, 6), 3) for q in (1, 2)]
    out = relational.similar(q, c)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2  # candidates, and the best of each task
    monkeypatch.setattr(relational, "MOST", 0)
    assert sorted(map(tuple, relational.similar(q, c).collect())) == sorted(want)
