"""Queries of parsers, writers and file sets: small catalog files are made of `part`, one for each row, and read back; the
twins write out the rows that the files hold. Imported for its registrations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..functions import placeholders as H
from ..functions import text as X
from ..operators import project as J
from ..operators import relational as R
from ..sources import catalog, formats, trees, writers
from .registry import _table, query



def part_id() -> Column:
    """The part that a file was made of."""
    return F.regexp_extract("path", r"f([0-9]+)/", 1).cast("long").alias("id")


def made(template: str) -> Column:
    """A text with <id>, <name>, <brand> and <size> of a part in it."""
    cells = {"<id>": F.col("p_partkey").cast("string"), "<name>": F.col("p_name"), "<brand>": F.col("p_brand"), "<size>": F.col("p_size").cast("string")}
    return F.concat(*[cells.get(x) if x in cells else F.lit(x) for x in re.split("(<id>|<name>|<brand>|<size>)", template) if x])


def found(spark: SparkSession, d: str, format_: str, texts: dict[str, str], where: str = "true") -> DataFrame:
    """path, format, content of files: for each part one of each name."""
    part = _table(spark, d, "part").filter(where)
    out = None
    for name, template in texts.items():
        one = part.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit("/" + name)).alias("path"), F.lit(format_).alias("format"), F.encode(made(template), "UTF-8").alias("content"))
        out = one if out is None else out.union(one)
    return out


def scanned(spark: SparkSession, d: str, format_: str, text: str, name: str = "x") -> DataFrame:
    return catalog.scan(spark, found(spark, d, format_, {name: text})).withColumn("id", part_id())


def rows(columns: str, *cells: str) -> str:
    """Twin: for each part the rows of cells, an SQL expression for each column."""
    names = columns.split()
    return " UNION ALL ".join("SELECT p_partkey AS id, " + ", ".join(f"{e} AS {c}" for e, c in zip(_cells(x), names, strict=True)) + " FROM part" for x in cells)


def _cells(text: str) -> list[str]:
    return [c.strip() for c in text.split(" ; ")]


SIZE = "CAST(p_size AS VARCHAR)"
L = "CAST({} AS BIGINT)"

# ---- scans -----------------------------------------------------------------------------------------------------------


@query(
    "s1_encodings",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE p_name || ' é' END AS text, CASE WHEN p_partkey % 5 = 4 THEN 'not UTF-8' END AS error, CAST(CASE WHEN p_partkey % 5 = 4 THEN 2 ELSE 1 END AS BIGINT) AS line FROM part",
)
def s1(spark, d):
    m, text = F.col("p_partkey") % 5, made('"k" = "<name> é";\n')
    mark = lambda hex_: F.unhex(F.lit(hex_))
    content = F.when(m == 0, F.concat(mark("FFFE"), F.encode(text, "UTF-16LE"))).when(m == 1, F.concat(mark("FEFF"), F.encode(text, "UTF-16BE"))).when(m == 2, F.concat(mark("EFBBBF"), F.encode(text, "UTF-8")))
    content = content.when(m == 3, F.encode(text, "UTF-8")).otherwise(F.concat(F.encode(F.lit("/* é */\n"), "UTF-8"), F.encode(text, "ISO-8859-1")))
    files = _table(spark, d, "part").select(made("f<id>/x.strings").alias("path"), F.lit("strings").alias("format"), content.alias("content"))
    return catalog.scan(spark, files).select(part_id(), "text", "error", F.col("line").cast("long").alias("line"))


JSON = '{\n  "title": "<name>",\n  "menu": {"open": "Open \\"<brand>\\"", "list": ["a <size>", "\\u00e9"]},\n  "n": 5,\n  "title": ""\n}'


@query("s2_json_scan", rows("key text ordinal line", f"'title' ; p_name ; {L.format(0)} ; {L.format(2)}", f"""'menu.open' ; 'Open "' || p_brand || '"' ; {L.format(1)} ; {L.format(3)}""", f"'menu.list.0' ; 'a ' || {SIZE} ; {L.format(2)} ; {L.format(3)}", f"'menu.list.1' ; 'é' ; {L.format(3)} ; {L.format(3)}", f"'title' ; '' ; {L.format(4)} ; {L.format(5)}"))
def s2(spark, d):
    return scanned(spark, d, "json", JSON).select("id", "key", "text", F.col("ordinal").cast("long").alias("ordinal"), F.col("line").cast("long").alias("line"))


@query("s3_arb_scan", rows("key text comment", "'hello' ; 'Hallo {name} ' || p_name ; p_brand || '; {name}; {n}'", f"'plain' ; {SIZE} ; NULL"))
def s3(spark, d):
    text = '{"@@locale": "de", "hello": "Hallo {name} <name>", "@hello": {"description": "<brand>", "placeholders": {"name": {}, "n": {}}}, "plain": "<size>"}'
    return scanned(spark, d, "arb", text).select("id", "key", "text", "comment")


STRING_CATALOG = """{
  "sourceLanguage" : "en",
  "strings" : {
    "<name> %lld" : {
      "comment" : "<brand>",
      "localizations" : {
        "de" : { "stringUnit" : { "state" : "translated", "value" : "<name> <size>" } },
        "pl" : { "variations" : { "plural" : { "one" : { "stringUnit" : { "state" : "new", "value" : "<size>" } }, "other" : { "stringUnit" : { "state" : "translated", "value" : "<name>" } } } } }
      }
    },
    "Off" : { "shouldTranslate" : false }
  },
  "version" : "1.0"
}
"""


@query("s4_string_catalog_scan", rows("key locale text state comment", f"p_name || ' %lld' ; 'de' ; p_name || ' ' || {SIZE} ; 'translated' ; p_brand", "p_name || ' %lld' ; 'en' ; p_name || ' %lld' ; NULL ; p_brand"))
def s4(spark, d):
    return scanned(spark, d, "xcstrings", STRING_CATALOG).filter("category is null").select("id", "key", "locale", "text", "state", "comment")


@query("s5_string_catalog_plurals", rows("key locale category text state", f"p_name || ' %lld' ; 'pl' ; 'one' ; {SIZE} ; 'new'", "p_name || ' %lld' ; 'pl' ; 'other' ; p_name ; 'translated'"))
def s5(spark, d):
    return scanned(spark, d, "xcstrings", STRING_CATALOG).filter("category is not null").select("id", "key", "locale", "category", "text", "state")


ANDROID = """<?xml version="1.0" encoding="utf-8"?>
<resources>
    <!-- <brand> -->
    <string name="a">It\\'s &amp; <b><name></b></string>
    <string name="off" translatable="false"><size></string>
    <plurals name="n">
        <item quantity="one">%d <name></item>
        <item quantity="other">%d of <size></item>
    </plurals>
    <string-array name="l"><item><name></item><item>\\n<size></item></string-array>
</resources>
"""


@query(
    "s6_android_scan",
    rows(
        "kind key category idx text comment untranslatable",
        "'string' ; 'a' ; NULL ; NULL ; 'It''s & <b>' || p_name || '</b>' ; p_brand ; false",
        f"'string' ; 'off' ; NULL ; NULL ; {SIZE} ; NULL ; true",
        "'plurals' ; 'n' ; 'one' ; NULL ; '%d ' || p_name ; NULL ; false",
        f"'plurals' ; 'n' ; 'other' ; NULL ; '%d of ' || {SIZE} ; NULL ; false",
        f"'string-array' ; 'l' ; NULL ; {L.format(0)} ; p_name ; NULL ; false",
        f"'string-array' ; 'l' ; NULL ; {L.format(1)} ; chr(10) || {SIZE} ; NULL ; false",
    ),
)
def s6(spark, d):
    return scanned(spark, d, "android", ANDROID).select("id", "kind", "key", "category", F.col("index").cast("long").alias("idx"), "text", "comment", F.array_contains("flags", "translatable").alias("untranslatable"))


GETTEXT = """msgid ""
msgstr ""
"Language: pl\\n"
"Plural-Forms: nplurals=3; plural=0;\\n"

#. <brand>
#, fuzzy
msgctxt "menu"
msgid "Open <name>"
msgstr "Otw"
"órz \\"<size>\\""

msgid "%d <name>"
msgid_plural "%d <name>s"
msgstr[0] "a <size>"
msgstr[1] "b <size>"
msgstr[2] "c <size>"

#~ msgid "old"
#~ msgstr "<name>"
"""


@query("s7_gettext_scan", rows("key text comment fuzzy", f"""'menu' || chr(4) || 'Open ' || p_name ; 'Otwórz "' || {SIZE} || '"' ; p_brand ; true"""))
def s7(spark, d):
    return scanned(spark, d, "po", GETTEXT, "pl.po").filter("kind = 'string'").select("id", "key", "text", "comment", F.array_contains("flags", "fuzzy").alias("fuzzy"))


@query("s8_gettext_plurals", rows("key category text", *[f"'%d ' || p_name ; '{c}' ; '{t} ' || {SIZE}" for c, t in (("one", "a"), ("few", "b"), ("many", "c"))]))
def s8(spark, d):
    return scanned(spark, d, "po", GETTEXT, "pl.po").filter("kind = 'plural'").select("id", "key", "category", "text")


RESX = """<?xml version="1.0" encoding="utf-8"?>
<root>
  <data name="a" xml:space="preserve">
    <value><name> &lt; <size></value>
    <comment><brand></comment>
  </data>
  <data name="bin" mimetype="application/x"><value>AAAA</value></data>
  <data name="b"><value><size></value></data>
</root>
"""


@query("s9_resx_scan", rows("key text comment", f"'a' ; p_name || ' < ' || {SIZE} ; p_brand", f"'b' ; {SIZE} ; NULL"))
def s9(spark, d):
    return scanned(spark, d, "resx", RESX).select("id", "key", "text", "comment")


STRINGS = '/* <brand> */\n"a <size>" = "<name>\\n\\U00e9 \\"x\\"";\nbare = "<size>"; // end\n"a <size>" = "twice";\n'


@query("s10_strings_scan", rows("key text comment line", f"""'a ' || {SIZE} ; p_name || chr(10) || 'é "x"' ; p_brand ; {L.format(2)}""", f"'bare' ; {SIZE} ; NULL ; {L.format(3)}", f"'a ' || {SIZE} ; 'twice' ; NULL ; {L.format(4)}"))
def s10(spark, d):
    e = scanned(spark, d, "strings", STRINGS)
    return e.select("id", "key", "text", F.when(F.col("ordinal") == 0, F.col("comment")).alias("comment"), F.col("line").cast("long").alias("line"))


STRINGSDICT = """<?xml version="1.0" encoding="UTF-8"?>
<plist version="1.0"><dict>
<key>days</key>
<dict><key>NSStringLocalizedFormatKey</key><string>%#@d@ <name></string>
<key>d</key><dict><key>NSStringFormatSpecTypeKey</key><string>NSStringPluralRuleType</string><key>NSStringFormatValueTypeKey</key><string>lld</string>
<key>one</key><string>%lld <brand></string><key>other</key><string>%lld of <size></string></dict></dict>
</dict></plist>
"""


@query("s11_stringsdict_scan", rows("kind key category text", "'format' ; 'days' ; NULL ; '%#@d@ ' || p_name", "'plural' ; 'days#d' ; 'one' ; '%lld ' || p_brand", f"'plural' ; 'days#d' ; 'other' ; '%lld of ' || {SIZE}"))
def s11(spark, d):
    return scanned(spark, d, "stringsdict", STRINGSDICT).select("id", "kind", "key", "category", "text")


# ---- file sets and units ---------------------------------------------------------------------------------------------

TWO = {
    "en.json": '{"go": "Save <name>", "say": "", "old": "Old"}',
    "de.json": '{"go": "Sichern <size>", "say": "", "lost": "x"}',
    "m/en.json": '{"go": "Rescue <brand>"}',
    "m/de.json": '{"go": "Retten <size>"}',
}
SPECS = [{"path": "m/en.json", "format": "json", "locale_path": "m/{locale}.json"}, {"path": "en.json", "format": "json", "locale_path": "{locale}.json"}]


def _two(spark: SparkSession, d: str) -> DataFrame:
    return catalog.scan(spark, found(spark, d, "json", TWO))


@query(
    "s12_attached_values",
    rows("file_set key locale source translation", f"'' ; 'go' ; 'de' ; 'Save ' || p_name ; 'Sichern ' || {SIZE}", "'' ; 'say' ; 'de' ; 'say' ; NULL", "'' ; 'old' ; 'de' ; 'Old' ; NULL", f"'m/' ; 'go' ; 'de' ; 'Rescue ' || p_brand ; 'Retten ' || {SIZE}"),
)
def s12(spark, d):
    """The same key in two modules keeps two sources and two translations; sets follow the files' layout."""
    u = catalog.units(catalog.attached(_two(spark, d)), "en")
    return u.select(F.regexp_extract("file_set", "^f([0-9]+)/", 1).cast("long").alias("id"), F.regexp_extract("file_set", "^f[0-9]+/(.*)[.]json$", 1).alias("file_set"), "key", "locale", "source", "translation")


@query("j1_configured_values", "SELECT key, locale, n, texts FROM (SELECT 'm/en.json:go' AS key, 'de' AS locale, count(*) AS n, count(DISTINCT 'Retten ' || CAST(p_size AS VARCHAR)) AS texts FROM part UNION ALL SELECT 'm/en.json:go', 'fr', count(*), 0 FROM part)")
def j1(spark, d):
    """[[files]] of a configuration: every part's module file is one source of the set; what it does not name is left out."""
    placed = catalog.attached(_two(spark, d), SPECS[:1]).withColumn("key", F.concat_ws("/", F.regexp_extract("path", "^f([0-9]+)", 1), "key"))
    u = catalog.prefixed(catalog.units(placed, "en", ["de", "fr"]))
    return u.groupBy(F.regexp_replace("key", ":[0-9]+/", ":").alias("key"), "locale").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("translation").alias("texts"))


@query("s26_key_listing", rows("key ordinal", f"'a ' || {SIZE} ; {L.format(0)}", f"'bare' ; {L.format(1)}", f"'a ' || {SIZE} ; {L.format(2)}"))
def s26(spark, d):
    return catalog.key_listing(scanned(spark, d, "strings", STRINGS)).select(part_id(), "key", F.col("ordinal").cast("long").alias("ordinal"))


@query("s25_plural_collectors", rows("key locale categories", "p_name || ' %lld' ; 'pl' ; 'one,other'"))
def s25(spark, d):
    forms = catalog.plural_forms(catalog.attached(catalog.scan(spark, found(spark, d, "xcstrings", {"x": STRING_CATALOG}))), "en")
    return forms.select(F.regexp_extract("file_set", "^f([0-9]+)/", 1).cast("long").alias("id"), "key", "locale", F.array_join("categories", ",").alias("categories"))


@query("s13_unit_loader", "SELECT p_partkey AS id, 'a' AS key, p_name AS source FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'c', 'x' FROM part")
def s13(spark, d):
    """Keys that a comment or a glob skips are gone; globs may name the file set."""
    part = _table(spark, d, "part")
    note = F.when(F.col("p_partkey") % 3 == 0, F.lit("<!-- polyglint:skip -->")).otherwise(F.lit("<!-- kept -->"))
    text = F.concat(F.lit("<resources>"), note, made('<string name="a"><name></string><string name="debug.b"><size></string><string name="c">x</string><string name="d">y</string></resources>'))
    files = part.select(made("f<id>/values/strings.xml").alias("path"), F.lit("android").alias("format"), F.encode(text, "UTF-8").alias("content"))
    files = files.union(part.select(made("f<id>/values-de/strings.xml").alias("path"), F.lit("android").alias("format"), F.encode(F.lit("<resources></resources>"), "UTF-8").alias("content")))
    u = catalog.units(catalog.attached(catalog.scan(spark, files)), "en", ["de"])
    u = J.unskipped(u, ["debug.*", "*/values/strings.xml:d"], "polyglint")
    return u.select(F.regexp_extract("file_set", "^f([0-9]+)/", 1).cast("long").alias("id"), "key", "source")


@query("a20_skipped_keys", "SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN 'debug.' ELSE 'ui.' END || p_brand AS key FROM part WHERE p_partkey % 4 = 0 OR p_size = 7")
def a20(spark, d):
    p = _table(spark, d, "part")
    key = F.concat(F.when(F.col("p_partkey") % 4 == 0, "debug.").otherwise("ui."), "p_brand", F.when(F.col("p_partkey") % 2 == 0, "#plural.one").otherwise("#plural.other"))
    return J.skipped_keys(p.select(key.alias("key"), F.when(F.col("p_size") == 7, "polyglint:skip").alias("comment")), ["debug.*"], "polyglint")


@query("j2_applicable_pairs", "SELECT p_partkey AS id, l AS locale FROM part, (VALUES ('de'), ('fr'), ('pl')) t(l) WHERE p_partkey % 3 <> 0 OR l = 'fr' OR (l = 'pl' AND p_partkey % 6 = 0)")
def j2(spark, d):
    only = F.when(F.col("p_partkey") % 6 == 0, F.array(F.lit("fr"), F.lit("pl"))).when(F.col("p_partkey") % 3 == 0, F.array(F.lit("fr")))
    units = _table(spark, d, "part").select(F.col("p_partkey").alias("id"), only.alias("locales"))
    return J.applicable(units, spark.createDataFrame([("de",), ("fr",), ("pl",)], "locale string"))


@query("p8_applicable", "SELECT p_partkey AS id, 'de' AS locale FROM part WHERE p_size % 2 = 0")
def p8(spark, d):
    units = _table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 1, F.array(F.lit("fr"))).alias("locales"))
    return J.applicable(units, spark.createDataFrame([("de",)], "locale string"))


@query("p7_chosen_locales", "SELECT doc_id, lang AS locale FROM documents WHERE lang IN ('de', 'fr')")
def p7(spark, d):
    return J.chosen(_table(spark, d, "documents").select("doc_id", F.col("lang").alias("locale")), ["de", "fr"], ["de", "es", "fr"])


@query("a1_coverage", "SELECT 'de' AS locale, 4 * count(*) AS total, CAST(2 * count(*) AS BIGINT) AS done FROM part")
def a1(spark, d):
    return R.unit_coverage(catalog.units(catalog.attached(_two(spark, d)), "en"))


# ---- findings of files -----------------------------------------------------------------------------------------------


@query("c1_syntax", "SELECT p_partkey AS id, CAST(CASE p_partkey % 3 WHEN 0 THEN 3 ELSE 2 END AS BIGINT) AS line, 'syntax' AS code, 'error' AS severity FROM part WHERE p_partkey % 3 < 2")
def c1(spark, d):
    m = F.col("p_partkey") % 3
    text = F.when(m == 0, made('{\n "a": "<name>",\n "b": "<size>"')).when(m == 1, made('{\n "a" "<name>"}')).otherwise(made('{"a": "<name>"}'))
    files = _table(spark, d, "part").select(made("f<id>/x.json").alias("path"), F.lit("json").alias("format"), F.encode(text, "UTF-8").alias("content"))
    return catalog.syntax_findings(catalog.scan(spark, files)).select(part_id(), F.col("line").cast("long").alias("line"), "code", "severity")


@query("c6_gettext_header", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 2 THEN 'warning' ELSE 'error' END AS severity FROM part WHERE p_size % 4 IN (1, 2)")
def c6(spark, d):
    m = F.col("p_size") % 4
    head = F.when(m == 0, "Plural-Forms: nplurals=3; plural=0;").when(m == 1, "Plural-Forms: nplurals=2; plural=0;").otherwise("Language: pl")
    body = F.when(m == 3, made('msgid "<name>"\nmsgstr "x"\n')).otherwise(made('msgid "<name>"\nmsgid_plural "<name>s"\nmsgstr[0] "x"\n'))
    text = F.concat(F.lit('msgid ""\nmsgstr "'), head, F.lit('\\n"\n\n'), body)
    files = _table(spark, d, "part").select(made("f<id>/pl.po").alias("path"), F.lit("po").alias("format"), F.encode(text, "UTF-8").alias("content"))
    return catalog.gettext_header_findings(catalog.scan(spark, files)).select(part_id(), "severity")


@query("c19_fuzzy", rows("key code", "'menu' || chr(4) || 'Open ' || p_name ; 'fuzzy'"))
def c19(spark, d):
    return catalog.flagged_findings(scanned(spark, d, "po", GETTEXT, "pl.po")).select(part_id(), "key", "code")


@query("c20_state", rows("key locale code", "p_name || ' %lld' ; 'pl' ; 'state'"))
def c20(spark, d):
    return catalog.flagged_findings(scanned(spark, d, "xcstrings", STRING_CATALOG)).select(part_id(), "key", "locale", "code")


# ---- writers ---------------------------------------------------------------------------------------------------------


def _edit(spark: SparkSession, d: str, key: str, value: str, name: str, category: str | None = None) -> DataFrame:
    p = _table(spark, d, "part")
    none = F.lit(None).cast("string")
    return p.select(made("f<id>/" + name).alias("path"), F.lit(key).alias("key"), none.alias("locale"), F.lit(category).cast("string").alias("category"), F.lit(None).cast("int").alias("index"), made(value).alias("value"))


def _written(out: DataFrame) -> DataFrame:
    return out.select(part_id(), F.decode("content", "UTF-8").alias("text"))


@query("k1_spliced_json", """SELECT p_partkey AS id, '{' || chr(10) || '  "title": "' || p_name || '",' || chr(10) || '  "menu": {"open": "Auf \\"' || p_brand || '\\" é", "list": ["a ' || CAST(p_size AS VARCHAR) || '", "\\u00e9"]},' || chr(10) || '  "n": 5,' || chr(10) || '  "title": ""' || chr(10) || '}' AS text FROM part""")
def k1(spark, d):
    return _written(catalog.write_values(spark, found(spark, d, "json", {"x.json": JSON}), _edit(spark, d, "menu.open", 'Auf "<brand>" é', "x.json")))


@query("k1_spliced_android", """SELECT p_partkey AS id, replace('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<resources>' || chr(10) || '    <string name="a">It\\''s ' || CAST(p_size AS VARCHAR) || ' &amp; more</string>' || chr(10) || '    <string name="b">' || p_name || '</string>' || chr(10) || '</resources>' || chr(10), '', '') AS text FROM part""")
def k1_android(spark, d):
    text = '<?xml version="1.0" encoding="utf-8"?>\n<resources>\n    <string name="a">old</string>\n    <string name="b"><name></string>\n</resources>\n'
    return _written(catalog.write_values(spark, found(spark, d, "android", {"x.xml": text}), _edit(spark, d, "a", "It's <size> & more", "x.xml")))


@query("k2_string_catalog_text", """SELECT p_partkey AS id, '{' || chr(10) || '  "sourceLanguage" : "en",' || chr(10) || '  "strings" : {' || chr(10) || '    "' || p_name || '" : {' || chr(10) || chr(10) || '    }' || chr(10) || '  },' || chr(10) || '  "version" : "1.0"' || chr(10) || '}' AS text FROM part""")
def k2(spark, d):
    return writers.rewritten(spark, found(spark, d, "xcstrings", {"x": '{"sourceLanguage": "en", "strings": {"<name>": {}}, "version": "1.0"}'})).select(part_id(), F.decode("content", "UTF-8").alias("text"))


@query("k7_string_catalog_setters", """SELECT p_partkey AS id, '{' || chr(10) || '  "sourceLanguage" : "en",' || chr(10) || '  "strings" : {' || chr(10) || '    "k" : {' || chr(10) || '      "localizations" : {' || chr(10) || '        "de" : {' || chr(10) || '          "stringUnit" : {' || chr(10) || '            "state" : "translated",' || chr(10) || '            "value" : "' || p_name || '"' || chr(10) || '          }' || chr(10) || '        }' || chr(10) || '      }' || chr(10) || '    }' || chr(10) || '  }' || chr(10) || '}' AS text FROM part""")
def k7(spark, d):
    files = found(spark, d, "xcstrings", {"x": '{"sourceLanguage": "en", "strings": {"k": {}}}'})
    edits = _edit(spark, d, "k", "<name>", "x").withColumn("locale", F.lit("de"))
    return _written(catalog.upsert(spark, files, edits))


@query("k9_upsert", """SELECT p_partkey AS id, '{' || chr(10) || '  "a": "' || p_name || '",' || chr(10) || '  "b": {' || chr(10) || '    "c": "x"' || chr(10) || '  },' || chr(10) || '  "new": "' || CAST(p_size AS VARCHAR) || '"' || chr(10) || '}' || chr(10) AS text FROM part""")
def k9(spark, d):
    """One edit of a value that is there, one of a key that is not."""
    files = found(spark, d, "json", {"x.json": '{\n  "a": "old",\n  "b": {\n    "c": "x"\n  }\n}\n'})
    return _written(catalog.upsert(spark, files, _edit(spark, d, "a", "<name>", "x.json").union(_edit(spark, d, "new", "<size>", "x.json"))))


@query("k6_inserts", """SELECT p_partkey AS id, 'strings' AS format, '"a" = "1";' || chr(10) || '"b" = "' || p_name || '";' || chr(10) AS text FROM part
    UNION ALL SELECT p_partkey, 'android', '<resources>' || chr(10) || '  <string name="a">1</string>' || chr(10) || '  <string name="b">' || p_name || '</string>' || chr(10) || '</resources>' FROM part
    UNION ALL SELECT p_partkey, 'arb', '{"@@locale": "de", "a": "1", "b": "' || p_name || '"}' FROM part
    UNION ALL SELECT p_partkey, 'po', 'msgid "a"' || chr(10) || 'msgstr "1"' || chr(10) || chr(10) || 'msgid "b"' || chr(10) || 'msgstr "' || p_name || '"' || chr(10) FROM part
    UNION ALL SELECT p_partkey, 'resx', '<root>' || chr(10) || '  <data name="a"><value>1</value></data>' || chr(10) || '  <data name="b" xml:space="preserve">' || chr(10) || '    <value>' || p_name || '</value>' || chr(10) || '  </data>' || chr(10) || '</root>' FROM part""")
def k6(spark, d):
    texts = {
        "strings": '"a" = "1";\n',
        "android": '<resources>\n  <string name="a">1</string>\n</resources>',
        "arb": '{"@@locale": "de", "a": "1"}',
        "po": 'msgid "a"\nmsgstr "1"\n',
        "resx": '<root>\n  <data name="a"><value>1</value></data>\n</root>',
    }
    out = None
    for f, text in texts.items():
        one = catalog.upsert(spark, found(spark, d, f, {f: text}), _edit(spark, d, "b", "<name>", f)).select(part_id(), F.lit(f).alias("format"), F.decode("content", "UTF-8").alias("text"))
        out = one if out is None else out.union(one)
    return out


@query("k3_locale_tree", """SELECT p_partkey AS id, '{' || chr(10) || '    "t": "' || p_name || '",' || chr(10) || '    "n_one": "eins",' || chr(10) || '    "n_few": "' || CAST(p_size AS VARCHAR) || '",' || chr(10) || '    "n_other": "viele",' || chr(10) || '    "own": "nur hier"' || chr(10) || '}' || chr(10) AS text FROM part""")
def k3(spark, d):
    p = _table(spark, d, "part")
    source, old = '{\n    "t": "Title",\n    "n_one": "one",\n    "n_other": "many",\n    "gone": "?"\n}\n', '{"own": "nur hier", "n_other": "viele", "n_one": "eins"}'
    wanted = p.select(made("f<id>/de.json").alias("path"), F.lit("json").alias("format"), F.lit("de").alias("locale"), F.lit(source).alias("source"), F.lit(old).alias("old"), F.create_map(F.lit("t"), F.col("p_name"), F.lit("n_few"), F.col("p_size").cast("string")).alias("values"))
    return writers.locale_files(spark, wanted).select(part_id(), F.decode("content", "UTF-8").alias("text"))


@query("k4_styles", """SELECT p_partkey AS id, '{' || chr(10) || repeat(' ', CAST(1 + p_size % 4 AS BIGINT)) || '"a": "' || p_name || '"' || chr(10) || '}' || CASE WHEN p_size % 2 = 0 THEN chr(10) ELSE '' END AS text FROM part""")
def k4(spark, d):
    p = _table(spark, d, "part")
    source = F.concat(F.lit("{\n"), F.repeat(F.lit(" "), (1 + F.col("p_size") % 4).cast("int")), F.lit('"a": "A"\n}'), F.when(F.col("p_size") % 2 == 0, "\n").otherwise(""))
    wanted = p.select(made("f<id>/de.json").alias("path"), F.lit("json").alias("format"), F.lit("de").alias("locale"), source.alias("source"), F.lit(None).cast("string").alias("old"), F.create_map(F.lit("a"), F.col("p_name")).alias("values"))
    return writers.locale_files(spark, wanted).select(part_id(), F.decode("content", "UTF-8").alias("text"))


@query("k5_arb_locale", """SELECT p_partkey AS id, '{' || chr(10) || '  "@@locale": "de",' || chr(10) || '  "b": "' || p_name || '",' || chr(10) || '  "a": "' || CAST(p_size AS VARCHAR) || '"' || chr(10) || '}' AS text FROM part""")
def k5(spark, d):
    p = _table(spark, d, "part")
    source = '{\n  "b": "B",\n  "@b": {"description": "d"},\n  "a": "A",\n  "c": "C"\n}'
    wanted = p.select(made("f<id>/app_de.arb").alias("path"), F.lit("arb").alias("format"), F.lit("de").alias("locale"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("old"), F.create_map(F.lit("a"), F.col("p_size").cast("string"), F.lit("b"), F.col("p_name")).alias("values"))
    return writers.locale_files(spark, wanted).select(part_id(), F.decode("content", "UTF-8").alias("text"))


@query("k8_templates", """SELECT DISTINCT lang, 'msgid ""' || chr(10) || 'msgstr ""' || chr(10) || '"Language: ' || lang || '\\n"' || chr(10) || '"MIME-Version: 1.0\\n"' || chr(10) || '"Content-Type: text/plain; charset=UTF-8\\n"' || chr(10) || '"Plural-Forms: nplurals=2; plural=' || '(n ' || CASE lang WHEN 'fr' THEN '!=' ELSE '!=' END || ' 1);\\n"' || chr(10) AS text FROM documents""")
def k8(spark, d):
    langs = _table(spark, d, "documents").select("lang").distinct()
    wanted = langs.select("lang", F.lit("po").alias("format"), F.col("lang").alias("locale"))
    return writers.templates(spark, wanted).select(F.col("locale").alias("lang"), "text")


@query("k24_utf16", "SELECT p_partkey AS id, 'fffe22006b00220020003d00200022007a0022003b000a00' AS hex FROM part")
def k24(spark, d):
    p = _table(spark, d, "part")
    content = F.concat(F.unhex(F.lit("FFFE")), F.encode(made('"k" = "<name>";\n'), "UTF-16LE"))
    files = p.select(made("f<id>/x.strings").alias("path"), F.lit("strings").alias("format"), content.alias("content"))
    return catalog.write_values(spark, files, _edit(spark, d, "k", "z", "x.strings")).select(part_id(), F.lower(F.hex("content")).alias("hex"))


# ---- the placeholder grammar -----------------------------------------------------------------------------------------


@query("f2_placeholders", "SELECT p_partkey AS id, '%1$@|{n}|{n}/plural|{{x}}|$t(k)|$who' AS tokens FROM part")
def f2(spark, d):
    text = made("%@ <name> {n, plural, one {<size>} other {# of {{x}}}} $t(k) costs $5 for $who 100%%")
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(H.extract_udf(text), "|").alias("tokens"))


@query("f5_dollar_tokens", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '$name' ELSE '' END AS tokens FROM part")
def f5(spark, d):
    text = F.when(F.col("p_size") % 2 == 0, made("<size>$name")).otherwise(made("pay $<size> or $ <name>"))
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(H.extract_udf(text), "|").alias("tokens"))


@query("f8_forms", "SELECT p_partkey AS id, p_size % 3 = 1 AS bad FROM part")
def f8(spark, d):
    """`one` may leave out the count in German, not in Russian, whose `one` also stands for 21."""
    locale = F.when(F.col("p_size") % 3 == 0, "de").when(F.col("p_size") % 3 == 1, "ru").otherwise("en")
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), H.mismatch_udf(made("%d <name>"), made("<name>"), locale, F.lit("one")).isNotNull().alias("bad"))


@query("f10_icu_gaps", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'n:few,n:many' ELSE '' END AS gaps FROM part")
def f10(spark, d):
    locale = F.when(F.col("p_size") % 2 == 0, "pl").otherwise("de")
    gaps = H.plural_gaps_udf(made("{n, plural, one {<name>} other {# <brand>}}"), locale)
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(gaps, ",").alias("gaps"))


@query("f12_prose", "SELECT p_partkey AS id, 'Read  about  ' || p_name || '  at  now' AS prose FROM part")
def f12(spark, d):
    text = made("Read %1$d about {a {b}} <name> <b></b> at https://x.example.com/<size> now")
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.trim(H.prose_udf(text)).alias("prose"))


@query("f19_android_codec", """SELECT p_partkey AS id, 'It''s "' || p_name || '" @' || chr(10) AS text, 'It\\''s \\"' || p_name || '\\" @\\n' AS raw FROM part""")
def f19(spark, d):
    raw = made("It\\'s \\\"<name>\\\" @\\n")
    decoded = formats.android_text(raw)
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), decoded.alias("text"), formats.android_raw(decoded).alias("raw"))


@query("f20_literals", """SELECT p_partkey AS id, '"' || p_name || ' \\"q\\" \\\\ \\n"' AS quoted, p_name || ' "q" \\ ' || chr(10) AS text FROM part""")
def f20(spark, d):
    text = made('<name> "q" \\ \n')
    quoted = formats.c_quoted_udf(text)
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), quoted.alias("quoted"), formats.c_string_udf(quoted).alias("text"))


TAGGED = "CASE lang WHEN 'en' THEN 'en-GB' WHEN 'fr' THEN 'fr_CA' WHEN 'es' THEN 'es-419' WHEN 'de' THEN 'de' ELSE 'xx' END"


@query(
    "f21_flags",
    f"SELECT DISTINCT {TAGGED} AS tag, CASE lang WHEN 'de' THEN chr(127465) || chr(127466) WHEN 'fr' THEN chr(127464) || chr(127462) WHEN 'es' THEN chr(127466) || chr(127480) WHEN 'en' THEN chr(127468) || chr(127463) ELSE chr(127760) END AS flag FROM documents",
)
def f21(spark, d):
    return _tags(spark, d).select("tag", X.flag(F.col("tag")).alias("flag"))


@query("f22_locale_names", f"SELECT DISTINCT {TAGGED} AS tag, CASE lang WHEN 'de' THEN 'German (de)' WHEN 'fr' THEN 'French (Canada) (fr_CA)' WHEN 'es' THEN 'Spanish (Latin America) (es-419)' WHEN 'en' THEN 'English (UK) (en-GB)' ELSE 'xx' END AS name FROM documents")
def f22(spark, d):
    return _tags(spark, d).select("tag", X.locale_name(F.col("tag")).alias("name"))


def _tags(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("lang")
    return _table(spark, d, "documents").select(F.when(m == "en", "en-GB").when(m == "fr", "fr_CA").when(m == "es", "es-419").when(m == "de", "de").otherwise("xx").alias("tag")).distinct()


@query("t8_size_guard", "SELECT p_partkey AS id, p_brand AS repository FROM part WHERE p_brand IN (SELECT s FROM (SELECT p_brand AS s, sum(p_size) AS bytes FROM part GROUP BY p_brand) WHERE bytes <= 200)")
def t8(spark, d):
    from ..streaming.limiter import within_size

    p = _table(spark, d, "part")
    return within_size(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("repository")), p.groupBy(F.col("p_brand").alias("repository")).agg(F.sum("p_size").alias("bytes")), 200)


PATHS = "CASE p_partkey % 8 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/a/' WHEN 2 THEN 'app/build/' WHEN 3 THEN 'lib/tests/' ELSE 'lib/' END || replace(p_name, ' ', '_') || CASE p_size % 7 WHEN 0 THEN '.kts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.test.ts' WHEN 3 THEN '.d.ts' WHEN 4 THEN '.html' WHEN 5 THEN '.rs' ELSE '.mm' END"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    m, n = F.col("p_partkey") % 8, F.col("p_size") % 7
    folder = F.when(m == 0, "src/").when(m == 1, "node_modules/a/").when(m == 2, "app/build/").when(m == 3, "lib/tests/").otherwise("lib/")
    tail = F.when(n == 0, ".kts").when(n == 1, ".tsx").when(n == 2, ".test.ts").when(n == 3, ".d.ts").when(n == 4, ".html").when(n == 5, ".rs").otherwise(".mm")
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(folder, F.replace("p_name", F.lit(" "), F.lit("_")), tail).alias("path"))


@query("s17_source_paths", f"SELECT p_partkey AS id, {PATHS} AS path FROM part WHERE p_partkey % 8 NOT IN (1, 2) AND p_size % 7 NOT IN (4, 5)")
def s17(spark, d):
    return _paths(spark, d).filter(trees.is_source(F.col("path")))


@query("s18_web_source_paths", f"SELECT p_partkey AS id, {PATHS} AS path FROM part WHERE p_partkey % 8 NOT IN (1, 2, 3) AND p_size % 7 IN (1, 4)")
def s18(spark, d):
    return _paths(spark, d).filter(trees.is_web_source(F.col("path")))


@query("p18_remote_addresses", "SELECT p_partkey AS id, p_partkey % 5 < 3 AS remote FROM part")
def p18(spark, d):
    m = F.col("p_partkey") % 5
    address = F.when(m == 0, made("https://git.example.com/a<id>.git")).when(m == 1, made("git@example.com:a/b<id>")).when(m == 2, made("owner/repo<id>")).when(m == 3, made("./folder/<id>")).otherwise(made("folder<id>"))
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), trees.remote(address).alias("remote"))


@query("p11_locale_suffixes", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'app' WHEN 1 THEN 'my_app' WHEN 2 THEN 'app_widget' ELSE 'app' END AS prefix, CASE p_size % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'pt_BR' WHEN 2 THEN NULL ELSE 'sr-Latn' END AS locale FROM part")
def p11(spark, d):
    m = F.col("p_size") % 4
    stem = F.when(m == 0, "app_de").when(m == 1, "my_app_pt_BR").when(m == 2, "app_widget").otherwise("app.sr-Latn")
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.locale_suffix(stem).alias("x")).select("id", "x.prefix", "x.locale")


@query("f23_interpolations", "SELECT p_partkey AS id, 'Hi {{0}}, ' || p_name || ' costs {{1}}' AS text, 'user.name|p' || CAST(p_size AS VARCHAR) AS expressions FROM part")
def f23(spark, d):
    from ..session import ship

    ship(spark)
    parts = F.split(markup.interpolated_udf(made("Hi ${user.name}, <name> costs {p<size>}")), "\x1f")
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), parts[0].alias("text"), F.array_join(F.slice(parts, 2, 9), "|").alias("expressions"))


COMPONENT = '<div>\n  <h1>Buy <name> now</h1>\n  <img alt="Photo of <brand>" src="x.png"/>\n  {/* <p>Not this</p> */}\n  <code>let me be</code>\n</div>\nconst a = { label: "Size <size> only" };\n'


@query(
    "f27_component_copy",
    rows("kind text line", "'text' ; 'Buy ' || p_name || ' now' ; CAST(2 AS BIGINT)", "'attribute' ; 'Photo of ' || p_brand ; CAST(3 AS BIGINT)", f"'property' ; 'Size ' || {SIZE} || ' only' ; CAST(7 AS BIGINT)"),
)
def f27(spark, d):
    sources = _table(spark, d, "part").select(made("f<id>/x.tsx").alias("path"), made(COMPONENT).alias("text"))
    return markup.extracted(spark, sources).filter("skipped is null").select(part_id(), "kind", "text", F.col("line").cast("long").alias("line"))


@query("k19_rewritten_sources", """SELECT p_partkey AS id, 'import { t } from "./i18n"' || chr(10) || '<h1>{t("buy")}</h1>' || chr(10) || '<p title={t("hint")}>' || p_brand || ' is good</p>' AS text FROM part""")
def k19(spark, d):
    text = made('<h1>Buy <name> now</h1>\n<p title="Look at <size>"><brand> is good</p>')
    keys = F.create_map(made("Buy <name> now"), F.lit("buy"), made("Look at <size>"), F.lit("hint"))
    sources = _table(spark, d, "part").select(made("f<id>/x.tsx").alias("path"), text.alias("text"), keys.alias("keys"))
    return markup.rewritten(spark, sources, importing='import { t } from "./i18n"').select(part_id(), "text")


@query("k22_bulk_values", """SELECT p_partkey AS id, '"a" = "' || p_name || '";' || chr(10) || '"b" = "' || p_brand || '";' || chr(10) || '"c" = "' || CAST(p_size AS VARCHAR) || '";' || chr(10) AS text FROM part""")
def k22(spark, d):
    """Three edits of each file, which is parsed and written once."""
    edits = _edit(spark, d, "a", "<name>", "x").union(_edit(spark, d, "b", "<brand>", "x")).union(_edit(spark, d, "c", "<size>", "x"))
    return _written(catalog.write_values(spark, found(spark, d, "strings", {"x": '"a" = "1";\n"b" = "2";\n"c" = "3";\n'}), edits))


@query("s24_plural_units", "SELECT p_partkey AS id, c AS category, CASE c WHEN 'one' THEN p_name ELSE p_brand END AS source FROM part, (VALUES ('one'), ('few'), ('many'), ('other')) t(c)")
def s24(spark, d):
    """Units of an Android plural for a target that needs more forms than its source has: the others take the source's `other`."""
    text = '<resources><plurals name="n"><item quantity="one"><name></item><item quantity="other"><brand></item></plurals></resources>'
    e = catalog.scan(spark, found(spark, d, "android", {"values/strings.xml": text}))
    forms = e.select(F.concat_ws("/", F.regexp_extract("path", "f([0-9]+)/", 1), "key").alias("key"), "category", F.col("text").alias("source"))
    out = R.plural_units(forms, spark.createDataFrame([("one",), ("few",), ("many",), ("other",)], "category string"))
    return out.select(F.split("key", "/")[0].cast("long").alias("id"), X.plural_category(F.col("key")).alias("category"), "source")
