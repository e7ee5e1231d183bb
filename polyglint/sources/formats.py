"""Parsers of catalog formats: text to entries with the span of the value in the file.

Each is a plain function `parse(text) -> list[Entry]` that raises Broken with a line number; `sources.catalog` runs them
over files in Arrow batches.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Entry:
    key: str
    text: str
    ordinal: int = 0
    kind: str = "string"
    locale: str | None = None
    category: str | None = None
    index: int | None = None
    comment: str | None = None
    state: str | None = None
    start: int = -1  # of the raw value, in characters of the text
    end: int = -1
    line: int = 1
    flags: list[str] = field(default_factory=list)


class Broken(ValueError):
    def __init__(self, line: int, message: str):
        super().__init__(f"line {line}: {message}")
        self.line, self.message = line, message


def read_text(data: bytes) -> str:
    """UTF-16 by its byte-order mark, else strict UTF-8, without the mark."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise Broken(data[: e.start].count(b"\n") + 1, "not UTF-8") from e


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


class Lines:
    """line_of() of one place after the other: what stands between two of them is read, not all that stands before."""

    def __init__(self, text: str):
        self.text, self.at, self.line = text, 0, 1

    def __call__(self, at: int) -> int:
        self.line += self.text.count("\n", self.at, at) if at >= self.at else -self.text.count("\n", at, self.at)
        self.at = at
        return self.line


# ---- JSON -------------------------------------------------------------------------------------------------------------

_JSON_TOKEN = re.compile(r'\s*(?:(?P<string>"[^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*")|(?P<mark>[{}\[\]:,])|(?P<plain>-?[0-9][-+.0-9eE]*|true|false|null))')


def json_leaves(text: str) -> Iterator[tuple[tuple[str, ...], str | None, int, int]]:
    """(path, string value or None, start, end of the value with its quotes), in file order, duplicates kept."""
    match, at = _JSON_TOKEN.match, 0

    def token() -> re.Match:
        nonlocal at
        m = match(text, at)
        if not m:
            raise Broken(line_of(text, at), "unexpected character" if text[at:].strip() else "unexpected end of file")
        at = m.end()
        return m

    def string(m: re.Match) -> str:
        quoted = m[1]
        if "\\" not in quoted:
            return quoted[1:-1]
        try:
            return json.loads(quoted)
        except json.JSONDecodeError as e:
            raise Broken(line_of(text, m.start(1)), e.msg) from e

    m = match(text)
    if not m or m[2] != "{":
        raise Broken(1, "root is not an object")
    at = m.end()
    path: tuple[str, ...] = ()
    inside: list[list] = []  # of each open object or array its end, its path and how many values it has
    while True:
        if m[2]:  # m begins the value of path
            if m[2] not in "{[":
                raise Broken(line_of(text, m.end() - 1), f"unexpected `{m[2]}`")
            close = "}" if m[2] == "{" else "]"
            ahead = match(text, at)
            if ahead and ahead[2] == close:
                at = ahead.end()
            else:
                inside.append([close, path, 0])
                m = None
        else:
            yield path, string(m) if m[1] else None, m.start(m.lastgroup), m.end()
        while m and inside:  # a value is over
            m = token()
            if m[2] == ",":
                break
            if m[2] != inside[-1][0]:
                raise Broken(line_of(text, m.end() - 1), f"expected `{inside[-1][0]}`")
            inside.pop()
        if not inside:
            break
        close, above, n = inside[-1]
        name = str(n)
        if close == "}":
            k = token()
            if not k[1]:
                raise Broken(line_of(text, k.end() - 1), "expected a key")
            name = string(k)
            m = token()
            if m[2] != ":":
                raise Broken(line_of(text, m.end() - 1), "expected `:`")
        path, inside[-1][2] = (*above, name), n + 1
        m = token()
    if text[at:].strip():
        raise Broken(line_of(text, at), "text after the root object")


def parse_json(text: str) -> list[Entry]:
    out, line = [], Lines(text)
    for path, v, a, b in json_leaves(text):
        if v is not None:
            key = ".".join(path)
            m = re.fullmatch(r"(.*)_(zero|one|two|few|many|other)", key)
            out.append(Entry(key, v, len(out), category=m and m[2], start=a, end=b, line=line(a)))
    return out


def parse_arb(text: str) -> list[Entry]:
    """Keys without @; descriptions and placeholder names of @key become its comment."""
    line = Lines(text)
    out = [Entry(path[0], v, start=a, end=b, line=line(a)) for path, v, a, b in json_leaves(text) if v is not None and len(path) == 1 and not path[0].startswith("@")]
    root = json.loads(text)
    for n, e in enumerate(out):
        about = root.get(f"@{e.key}")
        about = about if isinstance(about, dict) else {}
        names = [f"{{{x}}}" for x in about.get("placeholders") or {}]
        e.ordinal, e.comment = n, "; ".join([x for x in [about.get("description")] if x] + names) or None
    return out


def parse_xcstrings(text: str) -> list[Entry]:
    """Every locale's units of a string catalog; plural variations and substitutions with their category."""
    leaves = [(p, v, a, b) for p, v, a, b in json_leaves(text) if p[:1] == ("strings",) and len(p) > 1]
    source = json.loads(text).get("sourceLanguage", "en")
    meta: dict[str, dict[str, str]] = {}
    units: dict[tuple, dict] = {}
    line = Lines(text)
    for p, v, a, b in leaves:
        key, rest = p[1], p[2:]
        own = meta.setdefault(key, {})
        if len(rest) == 1:
            own[rest[0]] = v if v is not None else text[a:b]
        elif rest[0] == "localizations" and rest[-2:-1] == ("stringUnit",):
            units.setdefault((key, rest[1], rest[2:-2]), {})[rest[-1]] = (v, a, b)
    out: list[Entry] = []
    shown = set()
    for (key, locale, path), u in units.items():
        if meta[key].get("shouldTranslate") == "false" or "value" not in u:
            continue
        name = key + (f"#{path[path.index('substitutions') + 1]}" if "substitutions" in path else "")
        category = path[path.index("plural") + 1] if "plural" in path else None
        v, a, b = u["value"]
        shown |= {key} if locale == source else set()
        out.append(Entry(name, v or "", len(out), "plural" if category else "string", locale, category, None, meta[key].get("comment"), (u.get("state") or (None,))[0], a, b, line(a), ["stale"] if meta[key].get("extractionState") == "stale" else []))
    for key, own in meta.items():
        if key not in shown and own.get("shouldTranslate") != "false":
            out.append(Entry(key, key, len(out), locale=source, comment=own.get("comment"), flags=["stale"] if own.get("extractionState") == "stale" else []))
    return out


# ---- XML --------------------------------------------------------------------------------------------------------------


def _xml(text: str, wanted: set[str]) -> list[dict]:
    """Elements of the wanted names: attributes, raw inner text and its character span, parent, comment before them."""
    data = text.encode("utf-8")
    p, out, stack, comment = expat.ParserCreate("utf-8"), [], [], [None]
    spans: list[dict] = []

    def begin(name, attrs):
        at = p.CurrentByteIndex
        e = {"name": name, "attrs": attrs, "parent": stack[-1] if stack else None, "at": at, "comment": comment[0] if name in wanted else None, "line": p.CurrentLineNumber}
        head = data.index(b">", _attr_end(data, at)) + 1
        e["inner"] = head
        e["empty"] = data[head - 2 : head] == b"/>"
        stack.append(e)
        comment[0] = None

    def finish(name):
        e = stack.pop()
        e["stop"] = e["inner"] if e["empty"] else p.CurrentByteIndex
        if name in wanted:
            spans.append(e)
        comment[0] = None

    def chars(s):
        if s.strip():
            comment[0] = None

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = begin, finish, chars
    p.CommentHandler = lambda s: comment.__setitem__(0, s.strip())
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise Broken(e.lineno, expat.errors.messages[e.code]) from e
    last = characters = 0

    def place(at: int) -> int:  # characters before a byte; what stands between two places is read, not all before
        nonlocal last, characters
        characters += len(data[last:at].decode()) if at >= last else -len(data[at:last].decode())
        last = at
        return characters

    if len(data) == len(text):  # a byte for each character
        place = int  # noqa: F811
    for e in sorted(spans, key=lambda e: e["at"]):
        e["raw"] = data[e["inner"] : e["stop"]].decode()
        e["start"], e["end"] = place(e["inner"]), place(e["stop"])
        out.append(e)
    return out


_TAG_HEAD = re.compile(rb"<[^\s/>]+(?:\s+[^\s=/>]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*")


def _attr_end(data: bytes, at: int) -> int:
    """Past the attributes of the tag at `at`: a quoted > doesn't end it."""
    m = _TAG_HEAD.match(data, at)
    return m.end() if m else at


def decode_android(raw: str) -> str:
    """Displayed text of a resource's raw inner XML."""
    m = re.fullmatch(r"\s*<!\[CDATA\[(.*)\]\]>\s*", raw, re.DOTALL)
    text = m[1] if m else html.unescape(raw)
    if len(text) > 1 and text[0] == text[-1] == '"':
        text = text[1:-1]
    marks = {"n": "\n", "t": "\t", "'": "'", '"': '"', "\\": "\\", "@": "@", "?": "?"}
    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda x: chr(int(x[1], 16)) if x[1] else marks.get(x[2], x[2]), text, flags=re.DOTALL)


def encode_android(text: str, cdata: bool = False) -> str:
    out = re.sub(r"(\\|'|\")", r"\\\1", text).replace("\n", "\\n")
    out = "\\" + out if out[:1] in "@?" and out else out
    return f"<![CDATA[{out}]]>" if cdata else re.sub(r"&(?![A-Za-z#0-9]+;)", "&amp;", out).replace("<", "&lt;")


def escape_problem(raw: str) -> str | None:
    """error or warning: a reference that is none, a bare apostrophe, an odd number of bare double quotes."""
    value = raw.strip()
    if re.match(r"[@?]", value) and not re.fullmatch(r"[@?][A-Za-z0-9_.+:]+(?:/[A-Za-z0-9_.]*)?", value):
        return "error"
    if "<![CDATA[" in value or len(value) > 1 and value[0] == value[-1] == '"':
        return None
    bare = re.sub(r"\\.|<[^>]*>", "", value, flags=re.DOTALL)
    return "error" if "'" in bare else "warning" if bare.count('"') % 2 else None


def parse_android(text: str) -> list[Entry]:
    out: list[Entry] = []
    place: dict[int, int] = {}
    for e in _xml(text, {"string", "item", "plurals", "string-array"}):
        parent = e["parent"]
        own = e if e["name"] != "item" else parent
        if own is None or own["name"] not in ("string", "plurals", "string-array") or e["name"] in ("plurals", "string-array"):
            continue
        flags = [f for f in ("translatable", "formatted") if own["attrs"].get(f) == "false"]
        if problem := escape_problem(e["raw"]):
            flags.append(f"escape-{problem}")
        n = place[id(own)] = place.get(id(own), -1) + 1
        array = own["name"] == "string-array"
        out.append(Entry(own["attrs"].get("name", ""), decode_android(e["raw"]), len(out), own["name"], None, e["attrs"].get("quantity") if own["name"] == "plurals" else None, n if array else None, own["comment"], None, e["start"], e["end"], e["line"], flags))
    return out


def parse_resx(text: str) -> list[Entry]:
    out: list[Entry] = []
    parts = _xml(text, {"data", "value", "comment"})
    within: dict[int, dict[str, dict]] = {}
    for e in parts:
        within.setdefault(id(e["parent"]), {})[e["name"]] = e
    for d in (e for e in parts if e["name"] == "data"):
        if "type" in d["attrs"] or "mimetype" in d["attrs"]:
            continue
        inner = within.get(id(d), {})
        v = inner.get("value")
        if v:
            out.append(Entry(d["attrs"].get("name", ""), html.unescape(v["raw"]), len(out), comment=html.unescape(inner["comment"]["raw"]) if "comment" in inner else None, start=v["start"], end=v["end"], line=d["line"]))
    return out


def parse_stringsdict(text: str) -> list[Entry]:
    """Format keys, and each variable's forms under key#variable."""
    import plistlib

    try:
        tree = plistlib.loads(text.encode("utf-8"), fmt=plistlib.FMT_XML)
    except Exception as e:  # plistlib raises many kinds
        raise Broken(getattr(e, "lineno", 1), str(e)) from e
    out: list[Entry] = []
    for key, body in tree.items():
        at = text.find(f"<key>{html.escape(key, quote=False)}</key>")
        line = line_of(text, max(at, 0))
        for name, v in body.items():
            if name == "NSStringLocalizedFormatKey":
                out.append(Entry(key, v, len(out), "format", line=line))
            elif isinstance(v, dict):
                out += [Entry(f"{key}#{name}", t, len(out) + i, "plural", category=c, line=line) for i, (c, t) in enumerate((c, t) for c, t in v.items() if not c.startswith("NS"))]
    return out


# ---- gettext, Apple strings --------------------------------------------------------------------------------------------

_PO_LINE = re.compile(r'(?P<word>msgctxt|msgid_plural|msgid|msgstr)(?:\[(?P<slot>[0-9]+)\])?\s+(?P<text>".*")\s*$|(?P<more>".*")\s*$')
_C_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def c_string(quoted: str) -> str:
    if "\\" not in quoted:
        return quoted[1:-1]
    return re.sub(r"\\(.)", lambda m: _C_ESCAPE.get(m[1], m[1]), quoted[1:-1])


def c_quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'


def parse_po(text: str) -> list[Entry]:
    """An entry per msgstr; the header has the key ''. msgctxt and msgid are joined by U+0004."""
    from ..dims import GETTEXT_LABELS

    out: list[Entry] = []
    blocks, block = [], []
    at = 0
    for n, line in enumerate(text.splitlines(keepends=True), 1):
        if not line.strip():
            blocks.append(block)
            block = []
        else:
            block.append((n, at, line.rstrip("\r\n")))
        at += len(line)
    blocks.append(block)
    nplurals = 2
    for block in blocks:
        notes, fuzzy, got, last = [], False, {}, None
        for n, at, line in block:
            if line.startswith("#~"):
                continue
            if line.startswith("#"):
                if line[1:2] == ",":
                    fuzzy |= "fuzzy" in line
                elif line[1:2] == ".":
                    notes.append(line[2:].strip())
                continue
            m = _PO_LINE.match(line.strip())
            if not m or m["more"] and last is None:
                raise Broken(n, "not a gettext line")
            if m["more"]:
                got[last]["text"] += c_string(m["more"])
                got[last]["end"] = at + len(line)
            else:
                last = (m["word"], int(m["slot"] or 0))
                got[last] = {"text": c_string(m["text"]), "start": at + line.index('"'), "end": at + len(line), "line": n}
        if ("msgid", 0) not in got:
            continue
        if ("msgstr", 0) not in got:
            raise Broken(got["msgid", 0]["line"], "msgid without msgstr")
        key = got["msgid", 0]["text"]
        if not key and (m := re.search(r"nplurals\s*=\s*([0-9]+)", got["msgstr", 0]["text"])):
            nplurals = int(m[1])
        if ("msgctxt", 0) in got:
            key = got["msgctxt", 0]["text"] + "\u0004" + key
        plural = ("msgid_plural", 0) in got
        labels = GETTEXT_LABELS.get(nplurals, ())
        for (word, slot), v in got.items():
            if word == "msgstr":
                out.append(Entry(key, v["text"], len(out), "plural" if plural else "string" if key else "header", None, (labels[slot] if slot < len(labels) else str(slot)) if plural else None, None, " ".join(notes) or None, None, v["start"], v["end"], v["line"], ["fuzzy"] if fuzzy and key else []))
    return out


_STRINGS = re.compile(r'\s*(?:(?P<note>/\*(?P<body>.*?)\*/|//[^\n]*)|(?P<key>"(?:[^"\\]|\\.)*"|[A-Za-z0-9_.-]+)\s*=\s*(?P<value>"(?:[^"\\]|\\.)*")\s*;|(?P<end>$))', re.DOTALL)


def parse_strings(text: str) -> list[Entry]:
    out: list[Entry] = []
    at, note, line = 0, None, Lines(text)

    def plain(s: str) -> str:
        s = re.sub(r"\\[Uu]([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), s)
        return c_string(s) if s[:1] == '"' else s

    while at < len(text):
        m = _STRINGS.match(text, at)
        if not m:
            raise Broken(line_of(text, at + len(text[at:]) - len(text[at:].lstrip())), "expected `\"key\" = \"value\";`")
        if m["key"]:
            out.append(Entry(plain(m["key"]), plain(m["value"]), len(out), comment=note, start=m.start("value"), end=m.end("value"), line=line(m.start("key"))))
            note = None
        elif m["body"] is not None:
            note = m["body"].strip()
        at = max(m.end(), at + 1)
    return out


PARSERS = {"json": parse_json, "arb": parse_arb, "xcstrings": parse_xcstrings, "android": parse_android, "resx": parse_resx, "stringsdict": parse_stringsdict, "po": parse_po, "strings": parse_strings}


# ---- writing ----------------------------------------------------------------------------------------------------------

ENCODERS = {"json": lambda t: json.dumps(t, ensure_ascii=False), "arb": lambda t: json.dumps(t, ensure_ascii=False), "xcstrings": lambda t: json.dumps(t, ensure_ascii=False), "po": c_quoted, "strings": c_quoted, "android": encode_android, "resx": lambda t: html.escape(t, quote=False)}


def splice(text: str, format_: str, edits: dict[tuple[str, str | None, str | None, int | None], str]) -> str:
    """The file with the values of (key, locale, category, index) replaced, and every other character as it was."""
    spans = [(e.start, e.end, edits[k]) for e in PARSERS[format_](text) if e.start >= 0 and (k := (e.key, e.locale, e.category, e.index)) in edits]
    for a, b, new in sorted(spans, reverse=True):
        text = text[:a] + ENCODERS[format_](new) + text[b:]
    return text


# ---- literal codecs as Columns ------------------------------------------------------------------------------------------


def _codec(f: Callable[[str], str]):
    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else f(t))

    return run


android_text, android_raw = _codec(decode_android), _codec(encode_android)
c_quoted_udf, c_string_udf = _codec(c_quoted), _codec(c_string)
