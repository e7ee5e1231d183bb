from polyglint.operators import relational
from polyglint.plans import check
from polyglint.sources import config


def test_check_a_project(spark, tmp_path):
    files = {
        "i18n/en.json": '{"hi": "Hello {name}", "menu": {"save": "Save file", "save2": "Save file", "save3": "Save file"}, "n_one": "{{count}} file", "n_other": "{{count}} files", "old": "Old text:"}',
        "i18n/pl.json": '{"hi": "Witaj {imie}", "menu": {"save": "Zapisz", "save2": "Zapisz", "save3": "Utrwal"}, "n_one": "{{count}} plik", "n_other": "pliki", "gone": "x", "gone": "y", "old": "Stare"}',
        "i18n/de.json": '{"hi": "Hallo {name}", ',
        "res/values/strings.xml": '<resources><string-array name="r"><item>a</item><item>b</item></string-array><string name="two">%s of %s</string></resources>',
        "res/values-pl/strings.xml": '<resources><string-array name="r"><item>say " it</item></string-array></resources>',
    }
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    cfg = config.load('source_locale = "en"\n[keys]\nskip = ["menu.save2x"]\nignore = { whitespace = ["*"] }\n')
    r = check.check(spark, str(tmp_path), cfg)
    found = {(x.code, x.key, x.locale) for x in r.findings.collect()}
    for want in (
        ("placeholders", "i18n/en.json:hi", "pl"),
        ("inconsistent", "i18n/en.json:menu.save3", "pl"),
        ("orphan", "i18n/en.json:gone", "pl"),
        ("duplicate", "i18n/en.json:gone", "pl"),
        ("array", "res/values/strings.xml:r", "pl"),
        ("punctuation", "i18n/en.json:old", "pl"),
        ("placeholders", "res/values/strings.xml:two", "en"),
        ("escape", "res/values/strings.xml:r", "pl"),
    ):
        assert want in found, (want, found)
    assert ("syntax", None, None) in found
    assert {x.fix for x in r.findings.filter("key = 'i18n/en.json:hi'").collect()} == {"Witaj {name}"}
    assert [x.value for x in check.fixes(r).collect()] == ["Witaj {name}"]


def test_two_modules_with_one_key(spark, tmp_path):
    files = {
        "a/en.json": '{"go": "Save", "stay": "Stay here"}',
        "a/de.json": '{"go": "Speichern", "stay": "Bleib"}',
        "b/en.json": '{"go": "Rescue"}',
        "b/de.json": '{"go": "Retten"}',
        "c/de.json": '{"go": "Fremd"}',
    }
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    specs = '[[files]]\nformat = "json"\npath = "{0}/en.json"\nlocale_path = "{0}/{{locale}}.json"\n'
    cfg = config.load('source_locale = "en"\ntarget_locales = ["de", "fr"]\n' + specs.format("a") + specs.format("b") + '[keys]\nskip = ["b/en.json:none"]\n')
    terms = spark.createDataFrame([("de", "stay", "verweil")], "locale string, term string, required string")
    r = check.check(spark, str(tmp_path), cfg, glossary=terms)
    assert {(u.key, u.locale, u.source, u.translation) for u in r.units.collect()} == {
        ("a/en.json:go", "de", "Save", "Speichern"), ("a/en.json:go", "fr", "Save", None), ("a/en.json:stay", "de", "Stay here", "Bleib"),
        ("a/en.json:stay", "fr", "Stay here", None), ("b/en.json:go", "de", "Rescue", "Retten"), ("b/en.json:go", "fr", "Rescue", None),
    }
    assert {tuple(c) for c in r.coverage.collect()} == {("de", 3, 3), ("fr", 3, 0)}
    assert [(x.key, x.locale) for x in r.findings.filter("code = 'glossary'").collect()] == [("a/en.json:stay", "de")]


def test_translate_only_what_changed(spark):
    units = spark.createDataFrame([("a", "de", "One {x}", None), ("b", "de", "Two", "Zwei"), ("c", "de", "Three", None)], "key string, locale string, source string, translation string")
    from pyspark.sql import functions as F

    from polyglint.functions.text import content_hash

    keys = units.select("key", content_hash(F.col("source")).alias("source_hash"))
    locales = units.filter("translation is not null").select("key", "locale", content_hash(F.col("translation")).alias("hash"))
    reviews = spark.createDataFrame([], "key string, locale string, review_hash string")
    memory = spark.createDataFrame([("de", " Three", "Drei", "human"), ("de", "One {x}", "no", "model")], "locale string, source string, text string, by string")
    t = check.translate(spark, units, keys, locales, reviews, memory)
    assert [(r.key, r.reply) for r in t.recalled.collect()] == [("c", "Drei")]
    assert [(r.key, r.reply) for r in t.asked.collect()] == [("a", "⟦de⟧ One {x}")]
    assert {r.key for r in t.lock.collect()} == {"a", "b", "c"} and t.batches.count() == 1


def test_config_hints():
    assert config.hints('source_locales = "en"\nzzz = 1') == ["unknown key `source_locales`; did you mean `source_locale`?", "unknown key `zzz`"]
    assert relational.MOST > 0


def test_configuration_edits_and_readiness(tmp_path):
    text = '# ours\nsource_locale = "en"\ntarget_locales = ["de"] # more soon\n[[files]]\nformat = "json"\npath = "en.json"\nlocale_path = "x.json"\n'
    more = config.with_locales(text, ["fr"], ["de"])
    assert more == text.replace('["de"]', '["fr"]') and config.load(more).target_locales == ["fr"]
    assert config.with_locales("# x\n", ["de"]) == 'target_locales = ["de"]\n# x\n'
    assert config.doctor(text, str(tmp_path)) == ["en.json is missing", "x.json names no locale"]
    (tmp_path / "en.json").write_text("{}")
    assert config.doctor(text.replace("x.json", "{locale}.json"), str(tmp_path)) == []
    assert config.doctor("a = [", ".")[0].startswith("the configuration doesn't parse")


def test_one_file_finds_its_layout(tmp_path):
    from polyglint.sources import trees

    for name in ("app/i18n/en/common.json", "app/i18n/de/common.json", "app/other/alone.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    assert trees.single_file(str(tmp_path / "app/i18n/en/common.json")) == (str(tmp_path / "app/i18n"), "en/common.json")
    assert trees.single_file(str(tmp_path / "app/other/alone.json")) is None


def test_signed_bodies(spark):
    import hashlib
    import hmac

    from polyglint.streaming.limiter import signed

    good = "sha256=" + hmac.new(b"k", b"{}", hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([("{}", good), ("{ }", good), ("{}", None), (None, good)], "body string, signature string")
    assert [r.body for r in signed(rows, "k").collect()] == ["{}"]
