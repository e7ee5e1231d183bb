"""Copy in component sources: text between tags, attributes, properties; interpolations; and the rewrite to keys."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

# Names whose values people read, and elements whose content they don't.
ATTRIBUTES = "alt title placeholder label aria-label"
PROPERTIES = "label title text message description placeholder heading subtitle caption tooltip name header content"
SKIPPED_ELEMENTS = "script style code pre svg kbd samp"

_LEXEME = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.DOTALL)
_SKIP = re.compile(rf"<({'|'.join(SKIPPED_ELEMENTS.split())})\b.*?</\1\s*>|<!--.*?-->", re.DOTALL | re.IGNORECASE)
_RUN = re.compile(r"(?<=>)(?!\s*[;)=,])([^<>]*?[^\s<>][^<>]*?)(?=</?[A-Za-z>])")
_ATTRIBUTE = re.compile(rf"""(?<=[\s"'])({'|'.join(ATTRIBUTES.split())})=(?:"([^"{{}}]+)"|'([^'{{}}]+)')""")
_PROPERTY = re.compile(rf"""\b({'|'.join(PROPERTIES.split())})\s*:\s*(?:"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)')""")
_INTERPOLATION = re.compile(r"\$?\{\s*([^{}]+?)\s*\}")


@dataclass
class Hit:
    line: int
    kind: str
    text: str
    start: int
    end: int
    skipped: str | None = None


def is_copy(text: str) -> bool:
    """Words for people rather than an address, a number, a constant or code."""
    if not re.search(r"[^\W\d_]{2,}", text) or re.match(r"https?:|[./#@]", text) or re.search(r"[;=<>]|=>|&&|\|\||\?\.", text):
        return False
    return not re.fullmatch(r"[a-z]+(?:[A-Z_][A-Za-z0-9_]*)+|[A-Z0-9_]+|[a-z0-9]+(?:[-_./:][a-z0-9]+)+", text)


def interpolated(text: str) -> tuple[str, list[str]]:
    """`${e}` and `{e}` as {{0}}, {{1}}, ...; and the expressions."""
    found: list[str] = []

    def number(m: re.Match) -> str:
        found.append(m[1])
        return f"{{{{{len(found) - 1}}}}}"

    return _INTERPOLATION.sub(number, text), found


def extract(text: str) -> list[Hit]:
    """In text order. Comments and skipped elements hold none; strings hold none but as attributes and properties."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    live = _SKIP.sub(blank, text)
    out: list[Hit] = []

    def add(kind: str, m: re.Match, group: int) -> None:
        raw, start = m[group], m.start(group)
        clean = " ".join(raw.split())
        body, names = interpolated(clean)
        lead = len(raw) - len(raw.lstrip())
        reason = None if is_copy(re.sub(r"\{\{\d+\}\}", "", body)) else "not copy"
        if reason is None and names and not re.search(r"[^\W\d_]{2,}", re.sub(r"\{\{\d+\}\}", "", body)):
            reason = "only an expression"
        out.append(Hit(text.count("\n", 0, start) + 1, kind, body, start + lead, start + lead + len(raw.strip()), reason))

    code = _LEXEME.sub(lambda m: blank(m) if m[0][:2] in ("//", "/*") and not live[max(m.start() - 1, 0)] == ":" else m[0], live)
    for m in _RUN.finditer(code):
        add("text", m, 1)
    for m in _ATTRIBUTE.finditer(code):
        add("attribute", m, 2 if m[2] is not None else 3)
    for m in _PROPERTY.finditer(code):
        add("property", m, 2 if m[2] is not None else 3)
    return sorted(out, key=lambda h: (h.start, h.end))


def rewrite(text: str, keys: dict[str, str], call: str = "t", importing: str | None = None) -> str:
    """With each text that has a key replaced by a call; spans are replaced from the end, so none moves another."""
    changed = text
    for h in reversed(extract(text)):
        if h.skipped is None and h.text in keys:
            raw = text[h.start : h.end]
            names = interpolated(" ".join(raw.split()))[1]
            args = f", {{ {', '.join(f'{i}: {e}' for i, e in enumerate(names))} }}" if names else ""
            put = f'{call}("{keys[h.text]}"{args})'
            if h.kind == "property":
                changed = changed[: h.start - 1] + put + changed[h.end + 1 :]
            elif h.kind == "attribute":
                changed = changed[: h.start - 1] + f"{{{put}}}" + changed[h.end + 1 :]
            else:
                changed = changed[: h.start] + f"{{{put}}}" + changed[h.end :]
    if changed != text and importing and importing not in changed:
        changed = importing + "\n" + changed
    return changed


def extracted(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """path, text -> path, line, kind, text, start, end, skipped."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, h.line, h.kind, h.text, h.start, h.end, h.skipped) for p, t in zip(frame.path, frame.text, strict=True) for h in extract(t or "")]
            yield pd.DataFrame(rows, columns=["path", "line", "kind", "text", "start", "end", "skipped"])

    return sources.select("path", "text").mapInPandas(run, "path string, line int, kind string, text string, start int, end int, skipped string")


def rewritten(spark: SparkSession, sources: DataFrame, call: str = "t", importing: str | None = None) -> DataFrame:
    """path, text of sources (path, text, keys: a map of texts to keys) whose copy is replaced by calls."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame.path, "text": [rewrite(t or "", dict(k or {}), call, importing) for t, k in zip(frame.text, frame["keys"], strict=True)]})

    return sources.select("path", "text", "keys").mapInPandas(run, "path string, text string")


@F.pandas_udf(T.StringType())
def interpolated_udf(text: pd.Series) -> pd.Series:
    """The text with numbered placeholders, and behind a unit separator the expressions."""
    return text.map(lambda t: None if t is None else "\x1f".join((x := interpolated(t))[:1] + tuple(x[1])))
