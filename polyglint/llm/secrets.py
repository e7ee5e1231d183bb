"""Secret scan: op4.

An Aho-Corasick automaton over the keywords runs once over each text (ASCII lower-cased: code points keep their places).
Only at its hits are anchored regular expressions tried; formats that embed a checksum or a decodable header are
validated. Runs of hexadecimal digits have no keyword; one scan finds those that are long enough.
A web token is tried once in a run of its characters, at the first `eyJ` there, so that long runs take linear time.

Null and empty texts have no spans; rows that repeat an id are scanned each for itself.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .common import arrow_batches, inputs

# Kinds in the order of the contract, keywords, and patterns.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CODE_HOST = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
PACKAGE_HOST = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
WEB_TOKEN = re.compile(r"(eyJ[A-Za-z0-9_-]{8,}+)\.(eyJ[A-Za-z0-9_-]{4,}+)\.([A-Za-z0-9_-]{16,}+)")
WEB_RUN = re.compile(r"[A-Za-z0-9_-]*+")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}?-----END (?:[A-Z]+ )*PRIVATE KEY-----")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "code_host", "gho_": "code_host", "ghu_": "code_host", "ghs_": "code_host", "ghr_": "code_host",
    "npm_": "package_host", "eyj": "web_token", "-----begin ": "private_key",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """CRC-32 in six base-62 digits, as the token formats that embed it write it."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _sum_ok(m: re.Match) -> bool:
    return checksum62(m[1]) == m[2]


def _header_ok(m: re.Match) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


#: Of a kind: the pattern tried at a hit, and what a match must pass.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= 8),
    "access": (ACCESS, lambda m: len(m[0]) >= 16),
    "code_host": (CODE_HOST, _sum_ok),
    "package_host": (PACKAGE_HOST, _sum_ok),
    "web_token": (WEB_TOKEN, _header_ok),
    "private_key": (PRIVATE_KEY, lambda m: True),
}
ORDER = {k: i for i, k in enumerate([*BASE, "code_host", "package_host", "web_token", "private_key"])}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def scan(text: str, words) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind. Matches of a kind don't overlap, leftmost first."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits: dict[str, set[int]] = {}
    for end, (n, kind) in words.iter(low):
        hits.setdefault(kind, set()).add(end - n + 1)
    found = [("hex", m.start(), m.end()) for m in HEX.finditer(text)] if len(text) >= 32 else []
    for kind, places in hits.items():
        pattern, passes = RULES[kind]
        free = 0
        for at in sorted(places):
            if at >= free and (m := pattern.match(text, at)):
                # a validated format leaves the rest of a failing match free; base kinds do not retry within one
                if passes(m):
                    found.append((kind, at, m.end()))
                    free = m.end()
                elif kind in BASE:
                    free = m.end()
            if kind == "web_token" and at >= free:
                free = WEB_RUN.match(text, at).end()
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]]))


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row per row of docs; a null or empty text has no span."""
    arrow_batches(spark)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, join = automaton(), lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            found = [scan(t, words) for t in batch.column(1).to_pandas()]
            cols = [pa.array([sum(x[0] == k for x in f) for f in found], pa.int64()) for k in BASE]
            base = [hashlib.sha256(join([x for x in f if x[0] in BASE]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(base, pa.string()), pa.array([join(f) for f in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return inputs(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in spans:
        if b > at:
            out.append(text[at:max(a, at)] + (f"<{kind}>" if a >= at else ""))
            at = b
    return "".join(out) + text[at:]
