"""Placeholders of translatable text: extraction, comparison, repair, ICU plurals; and their Arrow wrappers.

The grammar is recursive (ICU cases hold text with placeholders), which Column expressions can't follow. Callers filter
for the characters that can begin a placeholder first, so that prose never reaches Python.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import COUNT_MANDATORY, DEFAULT_REQUIRED, REQUIRED

# The grammar of printf conversions, by family of the conversion letter.
FAMILIES = {**dict.fromkeys("diuxXo", "d"), **dict.fromkeys("fFeEgGaA", "f"), "s": "s", "S": "s", "c": "c", "C": "c", "@": "@", "p": "p", "b": "b"}
PRINTF = regex.compile(
    r"""%(?:(?P<literal>%)|(?P<arg>arg)|
        (?:(?P<number>[0-9]+)\$)?(?:\#@(?P<variable>[A-Za-z0-9_]+)@|
        (?:\((?P<name>[^\s%)]+)\))?[-+#0',]*[0-9*]*(?:\.[0-9*]*)?[hlqLztj]*(?P<conversion>[@diufFeEgGxXosScCpaAb])))""",
    regex.VERBOSE,
)
BRACES = regex.compile(r"(?P<braces>\{(?:[^{}]+|(?&braces))*+\})")
BRACE_NAME = regex.compile(r"(?P<open>\{\{?) *(?P<name>[\p{L}\p{N}_.-]+)")
ICU = regex.compile(r"\s*,\s*(?P<kind>plural|selectordinal|select)\b\s*,?")
CASE = regex.compile(r"\s*(?P<key>[^\s{]+)\s*(?P<body>(?P<b>\{(?:[^{}]+|(?&b))*+\}))")
DOLLAR = regex.compile(r"\$(?:t\([^)]*\)|(?P<name>[\p{L}_][\p{L}\p{N}_]*))")
NUMBERED = regex.compile(r"%[0-9]+\$")
MALFORMED = "<malformed ICU>"


@dataclass(frozen=True)
class Placeholder:
    canonical: str
    raw: str
    name: str | None = None

    @property
    def shape(self) -> str | None:
        """What is left of it without its name; None if it has none that could be translated."""
        return None if self.name is None else self.canonical.replace(self.name, "", 1)

    def called(self, name: str) -> str:
        return self.raw if self.name is None else self.raw.replace(self.name, name, 1)


BRACE, STARTS = regex.compile("[{}]"), regex.compile("[%{$]")


def _icu(body: str) -> tuple[list[Placeholder], list[str], bool]:
    """Of `key {text} key {text} ...`: placeholders in the texts, keys, and whether it is well formed."""
    found, keys, at = [], [], 0
    while m := CASE.match(body, at):
        keys.append(m["key"])
        found += extract(m["body"][1:-1])
        at = m.end()
    return found, keys, not body[at:].strip()


def _partners(text: str) -> dict[int, int]:
    """Of each open brace that is closed, the place behind its partner; one pass."""
    open_, out = [], {}
    for m in BRACE.finditer(text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.end()
    return out


def _brace(text: str, at: int, partners: dict[int, int]) -> tuple[list[Placeholder], int]:
    end = partners.get(at)
    head = BRACE_NAME.match(text, at, end) if end else None
    if not head:
        return [], at + 1
    whole, wide = text[at:end], len(head["open"]) == 2
    if wide and not whole.endswith("}}"):
        return [], at + 1
    rest = whole[head.end() - at : -2 if wide else -1].strip()
    name = head["name"]
    free = name if (not rest or rest.startswith(",")) and not name.isdecimal() else None
    out = [Placeholder(f"{{{{{name}}}}}" if wide else f"{{{name}}}", whole, free)]
    if icu := ICU.match(rest):
        out.append(Placeholder(f"{{{name}}}/{icu['kind']}", whole, free))
        inner, keys, well = _icu(rest[icu.end() :])
        out += inner
        if not well or "other" not in keys:
            out.append(Placeholder(MALFORMED, whole))
    return out, end


def extract(text: str) -> list[Placeholder]:
    """In order. Unnumbered printf arguments take the next number."""
    out: list[Placeholder] = []
    at, unnumbered = 0, 1
    partners = _partners(text) if "{" in text else {}
    while m := STARTS.search(text, at):
        start = m.start()
        at = start + 1
        if text[start] == "{":
            found, at = _brace(text, start, partners)
            out += found
        elif text[start] == "$":
            if m := DOLLAR.match(text, start):
                out.append(Placeholder(m[0], m[0], m["name"]))
                at = m.end()
        elif m := PRINTF.match(text, start):
            at = m.end()
            if m["arg"]:
                out.append(Placeholder("%arg", "%arg"))
            elif m["variable"]:
                out.append(Placeholder("%#@…@", m[0]))
                unnumbered += m["number"] is None
            elif m["name"]:
                out.append(Placeholder(f"%({m['name']}){FAMILIES[m['conversion']]}", m[0], m["name"]))
            elif m["conversion"]:
                n = m["number"] or str(unnumbered)
                unnumbered += m["number"] is None
                out.append(Placeholder(f"%{int(n)}${FAMILIES[m['conversion']]}", m[0]))
    return out


def counts(text: str) -> Counter:
    """How often each placeholder counts: printf arguments of a numbered text, and named ones, at most once."""
    once = bool(NUMBERED.search(text))
    out = Counter(p.canonical for p in extract(text))
    for k in out:
        if k.startswith("%(") or once and k.startswith("%"):
            out[k] = 1
    return out


@dataclass(frozen=True)
class Mismatch:
    missing: tuple[str, ...]
    extra: tuple[str, ...]
    renamed: tuple[tuple[Placeholder, Placeholder], ...] = ()

    @property
    def message(self) -> str:
        said = []
        if self.renamed:
            pairs = list(dict.fromkeys(f"{a.canonical} → {b.canonical}" for a, b in self.renamed))
            said.append(f"placeholder name{'s' * (len(pairs) > 1)} translated: {', '.join(pairs)}")
        if self.missing:
            said.append("missing " + " ".join(self.missing))
        if self.extra:
            said.append("unexpected " + " ".join(self.extra))
        return "; ".join(said)


def _behind(text: str, canonical: Counter) -> list[Placeholder]:
    """The named placeholders that stand for so many occurrences of each canonical form, in text order."""
    left, out = Counter(canonical), []
    for p in extract(text):
        if left[p.canonical] > 0:
            left[p.canonical] -= 1
            if p.name is not None:
                out.append(p)
    return out


def compare(source: str, translation: str) -> Mismatch | None:
    """None if both hold the same placeholders. Missing and unexpected ones of equal shape, as many on both sides, are
    taken for translated names; shapes are visited once each, in order of appearance."""
    a, b = counts(source), counts(translation)
    missing, extra = a - b, b - a
    if not missing and not extra:
        return None
    lost, new, renamed = _behind(source, missing), _behind(translation, extra), []
    for shape in dict.fromkeys(p.shape for p in lost):
        x, y = [p for p in lost if p.shape == shape], [p for p in new if p.shape == shape]
        if len(x) == len(y):
            renamed += zip(x, y, strict=True)
    missing -= Counter(x.canonical for x, _ in renamed)
    extra -= Counter(y.canonical for _, y in renamed)
    return Mismatch(tuple(sorted(missing.elements())), tuple(sorted(extra.elements())), tuple(renamed))


def repair(source: str, translation: str) -> str | None:
    """The translation with the source's names put back, if translated names were all that was wrong."""
    m = compare(source, translation)
    if m is None or not m.renamed or m.missing or m.extra:
        return None
    out = translation
    for x, y in m.renamed:
        out = out.replace(y.raw, y.called(x.name or ""))
    return out if out != translation and compare(source, out) is None else None


def compare_forms(locale: str, category: str, source: str, translation: str) -> Mismatch | None:
    """As compare, but zero, one and two forms may leave out one count where they name an exact number."""
    m = compare(source, translation)
    lang = regex.split("[-_]", locale)[0].lower()
    if m is None or category not in ("zero", "one", "two") or lang in COUNT_MANDATORY or m.extra or m.renamed:
        return m
    left = list(m.missing)
    number = next((p for p in left if p.endswith(("$d", ")d", "$@", "$s")) or p in ("%arg", "{{count}}", "{count}", "{n}")), None)
    if number is None:
        return m
    left.remove(number)
    return replace(m, missing=tuple(left)) if left else None


def icu_plurals(text: str) -> list[tuple[str, list[str]]]:
    """(argument, case keys) of every ICU plural, outer ones first."""
    out: list[tuple[str, list[str]]] = []
    at = 0
    while (at := text.find("{", at)) >= 0:
        head, whole = BRACE_NAME.match(text, at), BRACES.match(text, at)
        if head and whole and (icu := ICU.match(whole[0][head.end() - at : -1])):
            body = whole[0][head.end() - at : -1][icu.end() :]
            cases = [(m["key"], m["body"][1:-1]) for m in CASE.finditer(body)]
            if icu["kind"] == "plural":
                out.append((head["name"], [k for k, _ in cases if not k.startswith("offset:")]))
            for _, inner in cases:
                out += icu_plurals(inner)
            at = whole.end()
        else:
            at += 1
    return out


def missing_categories(locale: str, present: list[str]) -> list[str]:
    """Categories the locale needs and a plural lacks; one with nothing but `other` (and =N) opted out."""
    if [c for c in present if not c.startswith("=")] == ["other"]:
        return []
    return [c for c in REQUIRED.get(regex.split("[-_]", locale)[0].lower(), DEFAULT_REQUIRED) if c not in present]


def _without_braces(text: str) -> str:
    out, at = [], 0
    for a, z in sorted(_partners(text).items()):
        if a >= at:
            out.append(text[at:a])
            at = z
    return "".join(out) + text[at:]


def prose(text: str) -> str:
    """Text without placeholders, tags and URLs."""
    text = regex.sub(r"<[^>]*>|(?:www\.|[A-Za-z0-9+.-]+://)[^\s)\"']*", "", text)
    text = _without_braces(text)
    return DOLLAR.sub("", regex.sub(r"%#@[^@]*@|%[^A-Za-z@%]*[hlqLzjt]*[A-Za-z@%]", "", text))


# Accents for pseudo-localisation, letter for letter.
PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
ACCENTED = "áƀçðéƒĝĥíĵķļɱñöþǫŕšţüṽŵẋýžÁƁÇÐÉƑĜĤÍĴĶĻṀÑÖÞǪŔŠŢÜṼŴẊÝŽ"
KEPT = regex.compile(rf"{BRACES.pattern}|{PRINTF.pattern}|<[^>]*>|&[A-Za-z#0-9]+;|{DOLLAR.pattern.replace('(?P<name>', '(?:')}", regex.VERBOSE)


def pseudo(text: str) -> str:
    """Accented text of the same placeholders in brackets, longer by a blank and a third of its letters."""
    table = str.maketrans(PLAIN, ACCENTED)
    out, at, n = [], 0, 0
    for m in KEPT.finditer(text):
        piece = text[at : m.start()]
        n += sum(map(str.isalpha, piece))
        out += [piece.translate(table), m[0]]
        at = m.end()
    n += sum(map(str.isalpha, text[at:]))
    out.append(text[at:].translate(table))
    return f"[{''.join(out)}{' ' if n else ''}{'~' * -(-n // 3)}]"


# ---- Arrow wrappers --------------------------------------------------------------------------------------------------


@F.pandas_udf(T.ArrayType(T.StringType()))
def extract_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else [p.canonical for p in extract(t)])


@F.pandas_udf(T.StringType())
def mismatch_udf(source: pd.Series, translation: pd.Series, locale: pd.Series, category: pd.Series) -> pd.Series:
    """A message, or null."""

    def one(s, t, loc, cat):
        if s is None or t is None:
            return None
        m = compare_forms(loc or "", cat, s, t) if cat else compare(s, t)
        return m.message if m else None

    return pd.Series([one(*x) for x in zip(source, translation, locale, category, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def repair_udf(source: pd.Series, translation: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or t is None else repair(s, t) for s, t in zip(source, translation, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def plural_gaps_udf(text: pd.Series, locale: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [f"{a}:{c}" for a, keys in icu_plurals(t) for c in missing_categories(loc or "", keys)] for t, loc in zip(text, locale, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def pseudo_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else pseudo(t))


@F.pandas_udf(T.StringType())
def prose_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else prose(t))


def register(spark) -> None:
    """The same functions for SQL."""
    for name, f in (("placeholders", extract_udf), ("placeholder_mismatch", mismatch_udf), ("placeholder_repair", repair_udf), ("plural_gaps", plural_gaps_udf), ("pseudo_localise", pseudo_udf), ("prose_of", prose_udf)):
        spark.udf.register(name, f)
