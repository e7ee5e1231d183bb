"""Project configuration: a small TOML file, read on the driver."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

# Known keys, for hints on unknown ones.
KEYS = "source_locale target_locales files provider length_ratio batch_size jobs context context_tokens memory extract keys".split()


@dataclass
class Config:
    source_locale: str = "en"
    target_locales: list[str] = field(default_factory=list)
    files: list[dict] = field(default_factory=list)
    length_ratio: float = 2.5
    batch_size: int = 20
    skip: list[str] = field(default_factory=list)
    ignore: dict[str, list[str]] = field(default_factory=dict)
    tool: str = "polyglint"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def hints(text: str) -> list[str]:
    """Of each unknown key, the known one it may stand for."""
    out = []
    for key in tomllib.loads(text):
        if key not in KEYS:
            near = min(KEYS, key=lambda k: distance(key, k))
            out.append(f"unknown key `{key}`" + (f"; did you mean `{near}`?" if distance(key, near) <= max(2, len(key) // 4) else ""))
    return out


def load(text: str) -> Config:
    t = tomllib.loads(text)
    keys = t.get("keys", {})
    return Config(t.get("source_locale", "en"), t.get("target_locales", []), t.get("files", []), float(t.get("length_ratio", 2.5)), int(t.get("batch_size", 20)), keys.get("skip", []), {k: v if isinstance(v, list) else [v] for k, v in keys.get("ignore", {}).items()})


def with_locales(text: str, add: list[str] = (), remove: list[str] = ()) -> str:
    """The configuration with target locales added or removed, everything else, comments too, as it was."""
    import re

    have = tomllib.loads(text).get("target_locales", [])
    wanted = [x for x in have if x not in remove] + [x for x in add if x not in have]
    line = "target_locales = [" + ", ".join(f'"{x}"' for x in wanted) + "]"
    at = re.compile(r"^target_locales\s*=\s*\[[^\]]*\]", re.MULTILINE)
    return at.sub(lambda m: line, text, count=1) if at.search(text) else line + "\n" + text


def doctor(text: str, root: str) -> list[str]:
    """What keeps a project from being checked or translated, in words; nothing if it is ready."""
    from pathlib import Path

    try:
        c = load(text)
    except (tomllib.TOMLDecodeError, ValueError) as e:
        return [f"the configuration doesn't parse: {e}"]
    out = [*hints(text)]
    if not c.target_locales:
        out.append("no target locales")
    if c.source_locale in c.target_locales:
        out.append(f"`{c.source_locale}` is both source and target")
    for f in c.files:
        if not (Path(root) / f["path"]).is_file():
            out.append(f"{f['path']} is missing")
        if f.get("locale_path") and "{locale}" not in f["locale_path"] and "{android_locale}" not in f["locale_path"]:
            out.append(f"{f['locale_path']} names no locale")
    return out
