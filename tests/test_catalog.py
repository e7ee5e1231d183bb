from pyspark.sql import functions as F

from polyglint.operators import checks, model, relational, render
from polyglint.sources import catalog
from polyglint.streaming import limiter


def write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_files_to_units_to_findings_and_back(spark, tmp_path):
    write(
        tmp_path,
        {
            "locales/en.json": '{"hi": "Hello {name}", "bye": "Bye", "menu": {"x": "Open: "}}',
            "locales/de.json": '{"hi": "Hallo {nome}", "bye": "", "menu": {"x": "Offen"}}',
            "locales/fr.json": '{"hi": "Salut {name}"',
            "res/values-pt-rBR/strings.xml": '<resources><string name="a">b</string></resources>',
            "x/readme.txt": "no catalog",
        },
    )
    found = catalog.files(spark, str(tmp_path))
    at = {r[0].rsplit("/", 1)[1]: (r[1], r[2]) for r in found.select("path", "format", "layout_locale").collect()}
    assert at == {"en.json": ("json", "en"), "de.json": ("json", "de"), "fr.json": ("json", "fr"), "strings.xml": ("android", "pt-BR")}
    entries = catalog.scan(spark, found.filter("format = 'json'")).cache()
    assert [r.message for r in catalog.syntax_findings(entries).collect()] == ["unexpected end of file"]
    units = catalog.units(catalog.attached(entries), "en").filter("translation is not null")
    assert sorted((r.key, r.translation) for r in units.collect()) == [("hi", "Hallo {nome}"), ("menu.x", "Offen")]
    bad = checks.placeholder_findings(spark, units).collect()
    assert [(r.key, r.fix) for r in bad] == [("hi", "Hallo {name}")]
    assert {r.code for r in checks.simple_findings(units).collect()} == {"whitespace", "punctuation"}
    edits = spark.createDataFrame([(r.path, "hi", None, None, None, "Hallo {name}") for r in found.filter(F.col("path").endswith("de.json")).collect()], "path string, key string, locale string, category string, index int, value string")
    out = catalog.write_values(spark, found, edits).collect()
    assert bytes(out[0].content).decode() == '{"hi": "Hallo {name}", "bye": "", "menu": {"x": "Offen"}}'


def test_gettext_header_and_flags(spark, tmp_path):
    write(tmp_path, {"po/pl.po": 'msgid ""\nmsgstr "Plural-Forms: nplurals=2;\\n"\n\n#, fuzzy\nmsgid "a"\nmsgstr "b"\n'})
    e = catalog.scan(spark, catalog.files(spark, str(tmp_path)))
    assert [(r.code, r.severity) for r in catalog.gettext_header_findings(e).collect()] == [("plural", "error")]
    assert [(r.key, r.code) for r in catalog.flagged_findings(e).collect()] == [("a", "fuzzy")]


def test_reports(spark):
    f = spark.createDataFrame([("f%d.json" % (i % 3), i % 4 if i % 5 else None, f"k{i}", "de", "length" if i % 2 else "markup", "warning" if i % 2 else "error", "a,b: 50%\n") for i in range(60)], "file string, line int, key string, locale string, code string, severity string, message string")
    assert render.json_report(f).count() == 60 and render.sarif_results(f).count() == 60
    assert render.annotations(f.filter("key = 'k1'")).first()[0] == "::warning file=f1.json,line=1,title=length de::k1: a,b: 50%25%0A"
    assert render.review_comments(f, 5).count() == 5
    assert render.text_report(f).filter("at = 21").count() == 2
    assert render.coverage_markdown(spark.createDataFrame([("de", 3, 4)], "locale string, done long, total long")).first()[0] == "| de | 3/4 | 75% |"
    assert len(render.sarif_rules()) == 24


def test_translation_is_validated_and_quarantined(spark):
    rows = spark.createDataFrame([("a", "de", "Hi {x}"), ("b", "de", "Bye")], "key string, locale string, source string")
    assert {r.state for r in model.translate(spark, rows).collect()} == {"accepted"}
    broken = model.translate(spark, rows, lambda s, loc: F.regexp_replace(s, r"\{.*?\}", ""), model.mock)
    assert {(r.key, r.state) for r in broken.collect()} == {("a", "repaired"), ("b", "accepted")}
    lost = model.translate(spark, rows, lambda s, loc: F.lit(""))
    assert {r.state for r in lost.collect()} == {"quarantined"}


def test_stream_and_batch_limiters_agree(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = limiter.admit(stream, 3, 6 * 3600, "36500 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("user_id", "event_id", "accepted").collect()}
    want = {tuple(r) for r in relational.limited(events, "user_id", "ts", "event_id", 3, 6 * 3600).collect()}
    assert got == want and len(want) == events.count()


def test_webhooks(spark):
    rows = spark.createDataFrame([('{"action":"opened","pull_request":{"number":1,"draft":false,"head":{"sha":"s"}},"repository":{"full_name":"o/r"},"installation":{"id":7}}',), ('{"action":"closed"}',), ("junk",)], "value string")
    assert [tuple(r) for r in limiter.only_requests(rows).collect()] == [(7, "o/r", 1, "s")]
