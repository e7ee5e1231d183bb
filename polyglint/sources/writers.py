"""New catalog files and entries. Whole files are assembled per file; edits of existing values are `formats.splice`."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from ..dims import CATEGORY_ORDER, GETTEXT_LABELS, GETTEXT_NPLURALS
from .formats import PARSERS, c_quoted, encode_android

# The plural rule that goes with a number of forms in a gettext header.
PLURAL_RULE = {1: "0", 2: "(n != 1)", 3: "(n%10==1 && n%100!=11 ? 0 : n%10>=2 && n%10<=4 && (n%100<10 || n%100>=20) ? 1 : 2)", 4: "(n==1 ? 0 : n==2 ? 1 : n==3 || n==4 ? 2 : 3)", 5: "(n==1 ? 0 : n==2 ? 1 : n<7 ? 2 : n<11 ? 3 : 4)", 6: "(n==0 ? 0 : n==1 ? 1 : n==2 ? 2 : n%100>=3 && n%100<=10 ? 3 : n%100>=11 ? 4 : 5)"}


def json_style(text: str) -> tuple[str | int | None, str]:
    """Indent and what stands behind the last brace."""
    m = re.search(r"\{\s*\n([ \t]+)\S", text)
    indent = m and m[1]
    return (indent if indent is None or "\t" in indent else len(indent)), text[len(text.rstrip()) :]


def _ordered(keys: list[str]) -> list[str]:
    """Plural siblings in the order of their categories, at the place of the first of them."""
    at, out = r"(.*)_(zero|one|two|few|many|other)", []
    for k in keys:
        m = re.fullmatch(at, k)
        group = [f"{m[1]}_{c}" for c in CATEGORY_ORDER if f"{m[1]}_{c}" in keys] if m else [k]
        out += [x for x in (group if len(group) > 1 else [k]) if x not in out]
    return out


def locale_tree(source: object, old: object, values: dict[str, str], path: tuple[str, ...] = ()) -> object | None:
    """A locale's tree in the source's shape: new values, else old ones, else nothing; keys that only the locale has stay."""
    if isinstance(source, dict):
        mine = old if isinstance(old, dict) else {}
        prefix = "".join(p + "." for p in path)
        names = [k[len(prefix) :] for k in values if k.startswith(prefix) and "." not in k[len(prefix) :]]
        built = {k: locale_tree(source.get(k, ""), mine.get(k), values, (*path, k)) for k in _ordered([*source, *[x for x in [*mine, *names] if x not in source]])}
        return {k: v for k, v in built.items() if v is not None} or None
    if isinstance(source, list):
        mine = old if isinstance(old, list) else []
        items = [locale_tree(x, mine[i] if i < len(mine) else None, values, (*path, str(i))) for i, x in enumerate(source)]
        return [x for x in items if x is not None] or None
    new = values.get(".".join(path))
    return new if new is not None else old if old is not None else None if isinstance(source, str) else source


def json_locale(source_text: str, old_text: str | None, values: dict[str, str]) -> str:
    indent, tail = json_style(source_text)
    tree = locale_tree(json.loads(source_text), json.loads(old_text) if old_text else {}, values)
    return json.dumps(tree or {}, ensure_ascii=False, indent=indent) + tail


def arb_locale(template_text: str, locale: str, values: dict[str, str]) -> str:
    """@@locale first, then the template's keys in order, without their metadata."""
    indent, tail = json_style(template_text)
    body = {"@@locale": locale} | {k: values[k] for k in json.loads(template_text) if not k.startswith("@") and k in values}
    return json.dumps(body, ensure_ascii=False, indent=indent) + tail


def xcstrings_text(root: dict) -> str:
    """A catalog in the style its editor writes: two blanks, a blank before each colon, empty objects over two lines."""

    def emit(x: object, pad: str) -> str:
        if isinstance(x, dict):
            inner = ",\n".join(f"{pad}  {json.dumps(k, ensure_ascii=False)} : {emit(v, pad + '  ')}" for k, v in x.items())
            return "{\n" + (inner or "") + f"\n{pad}}}"
        if isinstance(x, list):
            return "[\n" + ",\n".join(f"{pad}  {emit(v, pad + '  ')}" for v in x) + f"\n{pad}]"
        return json.dumps(x, ensure_ascii=False)

    return emit(root, "")


def xcstrings_set(text: str, key: str, locale: str, value: str | dict[str, str], state: str = "translated") -> str:
    """With a locale's text, or its plural forms, set; locales stay sorted, and the rest as it is."""
    root = json.loads(text)
    entry = root["strings"].setdefault(key, {})
    unit = lambda v: {"stringUnit": {"state": state, "value": v}}
    own = unit(value) if isinstance(value, str) else {"variations": {"plural": {c: unit(value[c]) for c in CATEGORY_ORDER if c in value}}}
    entry["localizations"] = dict(sorted({**entry.get("localizations", {}), locale: own}.items()))
    return xcstrings_text(root) + text[len(text.rstrip()) :]


def po_header(locale: str) -> str:
    n = GETTEXT_NPLURALS.get(re.split("[-_]", locale)[0], 2)
    return f'msgid ""\nmsgstr ""\n"Language: {locale}\\n"\n"MIME-Version: 1.0\\n"\n"Content-Type: text/plain; charset=UTF-8\\n"\n"Plural-Forms: nplurals={n}; plural={PLURAL_RULE[n]};\\n"\n'


def po_entry(key: str, value: str | dict[str, str], plural: str | None = None, nplurals: int = 2, comment: str | None = None) -> str:
    context, _, id_ = key.rpartition("\u0004")
    lines = [f"#. {comment}"] if comment else []
    lines += [f"msgctxt {c_quoted(context)}"] if context else []
    lines.append(f"msgid {c_quoted(id_)}")
    if isinstance(value, str):
        lines.append(f"msgstr {c_quoted(value)}")
    else:
        lines.append(f"msgid_plural {c_quoted(plural or id_)}")
        lines += [f"msgstr[{i}] {c_quoted(value.get(c, ''))}" for i, c in enumerate(GETTEXT_LABELS[nplurals])]
    return "\n" + "\n".join(lines) + "\n"


def resx_template(text: str) -> str:
    """The file without its translatable data."""
    return re.sub(r"[ \t]*<data\b(?![^>]*\b(?:mime)?type=)[^>]*>.*?</data>[ \t]*\r?\n?", "", text, flags=re.DOTALL)


def _before(text: str, close: str, block: str) -> str:
    """A block on lines of its own before the closing tag."""
    at = text.rindex(close)
    head = text[:at].rstrip(" \t")
    return head + ("" if head.endswith("\n") else "\n") + block + "\n" + text[at:]


def _indent(text: str, tag: str) -> str:
    m = re.search(rf"\n([ \t]+)<{tag}\b", text)
    return m[1] if m else "    "


def insert(text: str, format_: str, key: str, value: str | dict[str, str] | list[str], after: str | None = None) -> str:
    """With a new entry, behind the entry `after` where the format has a place there, else at the end."""
    if format_ == "android":
        pad, name = _indent(text, "(?:string|plurals)"), html.escape(key)
        if isinstance(value, str):
            block = f'{pad}<string name="{name}">{encode_android(value)}</string>'
        elif isinstance(value, dict):
            block = f'{pad}<plurals name="{name}">\n' + "".join(f'{pad}{pad}<item quantity="{c}">{encode_android(value[c])}</item>\n' for c in CATEGORY_ORDER if c in value) + f"{pad}</plurals>"
        else:
            block = f'{pad}<string-array name="{name}">\n' + "".join(f"{pad}{pad}<item>{encode_android(v)}</item>\n" for v in value) + f"{pad}</string-array>"
        return _before(text, "</resources>", block)
    if format_ == "resx":
        pad = _indent(text, "data")
        return _before(text, "</root>", f'{pad}<data name="{html.escape(key)}" xml:space="preserve">\n{pad}{pad}<value>{html.escape(str(value), quote=False)}</value>\n{pad}</data>')
    if format_ == "strings":
        line = f"{c_quoted(key)} = {c_quoted(str(value))};\n"
        near = next((e for e in PARSERS["strings"](text) if e.key == after), None)
        at = text.find("\n", near.end) + 1 if near and text.find("\n", near.end) >= 0 else len(text)
        return text[:at] + ("" if not at or text[at - 1] == "\n" else "\n") + line + text[at:]
    if format_ == "po":
        return text.rstrip("\n") + "\n" + po_entry(key, value if isinstance(value, (str, dict)) else "")
    if format_ == "json":
        return json_locale(text, text, value if isinstance(value, dict) else {key: str(value)})
    if format_ == "arb":
        indent, tail = json_style(text)
        return json.dumps(json.loads(text) | {key: value}, ensure_ascii=False, indent=indent) + tail
    raise ValueError(f"{format_} has no inserts without a locale")


EMPTY_ANDROID = '<?xml version="1.0" encoding="utf-8"?>\n<resources>\n</resources>\n'


# ---- over tables -----------------------------------------------------------------------------------------------------


def locale_files(spark: SparkSession, wanted: DataFrame) -> DataFrame:
    """wanted: path, format (json, arb), locale, source (the source file's text), old (the locale's, or null), values (a map
    of keys). path, content of the locale's files, in the style of their sources."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [arb_locale(s, loc, dict(v)) if kind == "arb" else json_locale(s, old, dict(v)) for kind, loc, s, old, v in zip(f.format, f.locale, f.source, f.old, f["values"], strict=True)]
            yield pd.DataFrame({"path": f.path, "content": [t.encode() for t in texts]})

    return wanted.select("path", "format", "locale", "source", "old", "values").mapInPandas(run, "path string, content binary")


def rewritten(spark: SparkSession, found: DataFrame) -> DataFrame:
    """path, content of String Catalogs (path, content) in their editor's style."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [bytes(c).decode("utf-8-sig") for c in f.content]
            yield pd.DataFrame({"path": f.path, "content": [(xcstrings_text(json.loads(t)) + t[len(t.rstrip()) :]).encode() for t in texts]})

    return found.select("path", "content").mapInPandas(run, "path string, content binary")


def templates(spark: SparkSession, wanted: DataFrame) -> DataFrame:
    """locale, text of new, empty files. wanted: format (po, android, or resx with the source file's text), locale."""
    ship(spark)
    if "source" not in wanted.columns:
        from pyspark.sql import functions as F

        wanted = wanted.withColumn("source", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"locale": f.locale, "text": [po_header(loc) if kind == "po" else EMPTY_ANDROID if kind == "android" else resx_template(s) for kind, loc, s in zip(f.format, f.locale, f.source, strict=True)]})

    return wanted.select("format", "locale", "source").mapInPandas(run, "locale string, text string")
