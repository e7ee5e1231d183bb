import pytest

from polyglint.sources import formats as M


def test_json_keeps_order_duplicates_and_spans():
    text = '\n{"b": {"x": "1", "y": ["p", "q"]}, "a": "t\\u00e9", "a": "again", "n": 3}'
    e = M.parse_json(text)
    assert [(x.key, x.text) for x in e] == [("b.x", "1"), ("b.y.0", "p"), ("b.y.1", "q"), ("a", "té"), ("a", "again")]
    assert text[e[3].start : e[3].end] == '"t\\u00e9"'


@pytest.mark.parametrize("text,line", [("[]", 1), ('{"a": "b",\n "c" "d"}', 2), ('{"a": 1', 1), ("{} x", 1)])
def test_json_errors_have_lines(text, line):
    with pytest.raises(M.Broken) as e:
        M.parse_json(text)
    assert e.value.line == line


def test_arb_comments():
    e = M.parse_arb('{"@@locale": "en", "hi": "Hi {name}", "@hi": {"placeholders": {"name": {}}, "description": "greeting"}}')
    assert [(x.key, x.text, x.comment) for x in e] == [("hi", "Hi {name}", "greeting; {name}")]


def test_xcstrings_plurals_and_skips():
    text = """{"sourceLanguage": "en", "strings": {"%d days": {"comment": "c", "localizations": {
      "de": {"variations": {"plural": {"one": {"stringUnit": {"state": "new", "value": "%d Tag"}}, "other": {"stringUnit": {"state": "translated", "value": "%d Tage"}}}}}}},
      "Skip": {"shouldTranslate": false, "localizations": {"de": {"stringUnit": {"state": "x", "value": "y"}}}}, "Old": {"extractionState": "stale"}}, "version": "1.0"}"""
    e = M.parse_xcstrings(text)
    assert ("%d days", "de", "one", "%d Tag", "new") in [(x.key, x.locale, x.category, x.text, x.state) for x in e]
    assert [x.key for x in e if x.flags] == ["Old"] and not [x for x in e if x.key == "Skip"]
    assert [x.text for x in e if x.locale == "en"] == ["%d days", "Old"]


def test_android_comments_plurals_arrays_and_escapes():
    text = """<?xml version="1.0"?>
<resources>
  <!-- note -->
  <string name="a" formatted="false">it\\'s &lt;b&gt; <b>x</b></string>
  <plurals name="p"><item quantity="one">1</item><item quantity="other">n</item></plurals>
  <string-array name="r"><item>x</item><item>y</item></string-array>
  <string name="c"><![CDATA[a & b]]></string><string name="e"/>
</resources>"""
    e = M.parse_android(text)
    assert [(x.key, x.kind, x.category, x.index) for x in e] == [("a", "string", None, None), ("p", "plurals", "one", None), ("p", "plurals", "other", None), ("r", "string-array", None, 0), ("r", "string-array", None, 1), ("c", "string", None, None), ("e", "string", None, None)]
    assert e[0].comment == "note" and e[0].flags == ["formatted"] and e[0].text == "it's <b> <b>x</b>" and e[5].text == "a & b"
    assert text[e[4].start : e[4].end] == "y"


def test_po_contexts_plurals_and_fuzzy():
    text = 'msgid ""\nmsgstr ""\n"Plural-Forms: nplurals=3; plural=0;\\n"\n\n#. hint\n#, fuzzy\nmsgctxt "m"\nmsgid "a\\tb"\nmsgstr "x"\n"y"\n\nmsgid "n"\nmsgid_plural "ns"\nmsgstr[0] "1"\nmsgstr[1] "2"\nmsgstr[2] "3"\n\n#~ msgid "old"\n#~ msgstr "gone"\n'
    e = M.parse_po(text)
    assert [(x.key, x.text, x.category) for x in e[1:]] == [("m\u0004a\tb", "xy", None), ("n", "1", "one"), ("n", "2", "few"), ("n", "3", "many")]
    assert e[1].flags == ["fuzzy"] and e[1].comment == "hint"
    with pytest.raises(M.Broken):
        M.parse_po('msgid "a"\n\n')


def test_strings_comments_bare_keys_and_utf16():
    data = '/* note */\n"k" = "v\\U00e9";\n// line\nbare = "x\\n";\n'
    e = M.parse_strings(M.read_text(data.encode("utf-16")))
    assert [(x.key, x.text, x.comment) for x in e] == [("k", "vé", "note"), ("bare", "x\n", None)]


def test_resx_and_stringsdict():
    e = M.parse_resx('<root><data name="a" xml:space="preserve"><value>x &amp; y</value><comment>c</comment></data><data name="b" type="t"><value>z</value></data></root>')
    assert [(x.key, x.text, x.comment) for x in e] == [("a", "x & y", "c")]
    d = """<?xml version="1.0" encoding="UTF-8"?><plist version="1.0"><dict><key>n</key><dict><key>NSStringLocalizedFormatKey</key><string>%#@v@</string>
    <key>v</key><dict><key>NSStringFormatSpecTypeKey</key><string>NSStringPluralRuleType</string><key>one</key><string>1</string><key>other</key><string>%d</string></dict></dict></dict></plist>"""
    assert [(x.key, x.category, x.text) for x in M.parse_stringsdict(d)] == [("n", None, "%#@v@"), ("n#v", "one", "1"), ("n#v", "other", "%d")]


@pytest.mark.parametrize(
    "format_,text,key",
    [
        ("json", '{ "a" : "b",\r\n  "c":"d" }', "a"),
        ("strings", '"a" = "b"; /* x */ "c" = "d";', "a"),
        ("po", 'msgid "a"\nmsgstr "b"\n', "a"),
        ("android", '<resources><string name="a">b</string> </resources>', "a"),
        ("resx", '<root><data name="a"><value>b</value></data></root>', "a"),
    ],
)
def test_splice_changes_only_the_value(format_, text, key):
    assert M.splice(text, format_, {}) == text
    new = M.splice(text, format_, {(key, None, None, None): 'say "é" & <b>\n'})
    back = {e.key: e.text for e in M.PARSERS[format_](new)}
    assert back[key] == 'say "é" & <b>\n' or format_ in ("android", "resx")
    assert M.splice(new, format_, {(key, None, None, None): "b"}) == text


def test_not_utf8():
    with pytest.raises(M.Broken):
        M.read_text(b"a\nb\xff")
