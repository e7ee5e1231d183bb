import json

from polyglint.functions import markup
from polyglint.sources import formats, trees, writers


def test_json_locale_keeps_shape_old_values_and_plural_order():
    source = '{\n    "a": "A",\n    "n_one": "1",\n    "n_other": "n",\n    "m": {\n        "x": "X", "l": ["p", "q"]\n    }\n}\n'
    text = writers.json_locale(source, '{"m": {"x": "alt"}, "extra": "e"}', {"n_other": "no", "n_few": "nf", "n_one": "ne", "m.l.0": "P"})
    assert json.loads(text) == {"n_one": "ne", "n_few": "nf", "n_other": "no", "m": {"x": "alt", "l": ["P"]}, "extra": "e"}
    assert list(json.loads(text))[:3] == ["n_one", "n_few", "n_other"] and text.startswith('{\n    "') and text.endswith("}\n")


def test_arb_and_xcstrings():
    assert json.loads(writers.arb_locale('{"@@locale": "en", "b": "B", "@b": {}, "a": "A"}', "de", {"a": "x", "b": "y"})) == {"@@locale": "de", "b": "y", "a": "x"}
    text = '{\n  "sourceLanguage" : "en",\n  "strings" : {\n    "k" : {\n\n    }\n  },\n  "version" : "1.0"\n}'
    assert writers.xcstrings_text(json.loads(text)) == text
    new = writers.xcstrings_set(writers.xcstrings_set(text, "k", "fr", "f"), "k", "de", {"other": "d", "one": "e"})
    assert [(e.locale, e.category, e.text) for e in formats.parse_xcstrings(new) if e.locale != "en"] == [("de", "one", "e"), ("de", "other", "d"), ("fr", None, "f")]


def test_new_entries_can_be_read_again():
    po = writers.insert(writers.po_header("pl"), "po", "ctx\u0004id", "va\"lue")
    po += writers.po_entry("n", {"one": "1", "few": "2", "many": "3"}, "ns", 3)
    assert [(e.key, e.text, e.category) for e in formats.parse_po(po)][1:] == [("ctx\u0004id", 'va"lue', None), ("n", "1", "one"), ("n", "2", "few"), ("n", "3", "many")]
    xml = writers.EMPTY_ANDROID
    for k, v in (("a", "it's"), ("p", {"one": "1", "other": "n"}), ("r", ["x", "y"])):
        xml = writers.insert(xml, "android", k, v)
    assert [(e.key, e.text) for e in formats.parse_android(xml)] == [("a", "it's"), ("p", "1"), ("p", "n"), ("r", "x"), ("r", "y")]
    resx = writers.insert('<root>\n  <data name="a">\n    <value>b</value>\n  </data>\n</root>\n', "resx", "k", "x & y")
    assert [(e.key, e.text) for e in formats.parse_resx(resx)] == [("a", "b"), ("k", "x & y")]
    assert formats.parse_resx(writers.resx_template(resx)) == []
    s = writers.insert('"a" = "1";\n"c" = "3";\n', "strings", "b", "2", after="a")
    assert [e.key for e in formats.parse_strings(s)] == ["a", "b", "c"]


SOURCE = """// <p>not this</p>
const item = { label: "Save changes", id: "save-changes", url: "https://x.y" };
export const A = () => (
  <div title="Open the file" className="a b">
    <h1>Hello {user.name}, welcome</h1>
    <code>rm files</code>
    <p>{count}</p>
  </div>
);
"""


def test_copy_in_components():
    live = [(h.line, h.kind, h.text) for h in markup.extract(SOURCE) if h.skipped is None]
    assert live == [(2, "property", "Save changes"), (4, "attribute", "Open the file"), (5, "text", "Hello {{0}}, welcome")]
    out = markup.rewrite(SOURCE, {"Hello {{0}}, welcome": "hello", "Save changes": "save", "Open the file": "open"}, importing='import { t } from "i18n";')
    assert '<h1>{t("hello", { 0: user.name })}</h1>' in out and 'label: t("save")' in out and 'title={t("open")}' in out and out.startswith("import")


def test_source_trees(spark, tmp_path):
    for name, text in {"a/x.tsx": SOURCE, "a/x.test.tsx": SOURCE, "node_modules/y.js": "label: 'No No'", "b/v.swift": 'f("key.one")\ng(.two)\n', "i18n/en.json": '{"a": "b"}', "i18n/de.json": '{"a": "c"}', "res/values-de/strings.xml": "<resources/>"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    web = trees.web_sources(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in web.collect()] == ["x.tsx"]
    assert {r.text for r in markup.extracted(spark, web).filter("skipped is null").collect()} == {"Save changes", "Open the file", "Hello {{0}}, welcome"}
    keys = spark.createDataFrame([("key.one",), ("two",), ("gone",)], "key string")
    hits = trees.key_usages(trees.lines(trees.sources(spark, str(tmp_path))), keys).collect()
    assert sorted((r.key, r.line, r.strong) for r in hits) == [("key.one", 1, True), ("two", 2, False)]
    found = {(r.format, r.template.rsplit("/", 2)[1] + "/" + r.template.rsplit("/", 1)[1]): r.locales for r in trees.layouts(spark, str(tmp_path)).collect()}
    assert found[("json", "i18n/{locale}.json")] == ["de", "en"] and found[("android", "values-{locale}/strings.xml")] == ["de"]
    assert trees.is_remote("https://a.b/c") and trees.is_remote("own/repo") and not trees.is_remote("/tmp")


def test_flush_replaces_files(spark, tmp_path):
    from polyglint.sources import catalog

    (tmp_path / "en.json").write_text('{"a": "x"}')
    found = catalog.files(spark, str(tmp_path))
    path = found.first().path
    edits = spark.createDataFrame([(path, "a", None, None, None, "y"), (path, "b", None, None, None, "z")], "path string, key string, locale string, category string, index int, value string")
    catalog.flush(catalog.upsert(spark, found, edits))
    assert (tmp_path / "en.json").read_text() == '{"a": "y", "b": "z"}' and len(list(tmp_path.glob("*json*"))) == 1


def test_retries():
    import pytest

    from polyglint.operators.model import retrying

    slept, calls = [], []

    def ask(text):
        calls.append(text)
        if len(calls) < 3:
            raise OSError
        return text.upper()

    assert retrying(ask, sleep=slept.append)("a") == "A" and slept == [0.5, 1.0]
    calls.clear()
    with pytest.raises(OSError):
        retrying(ask, fatal=(OSError,), sleep=slept.append)("a")
    assert len(calls) == 1
