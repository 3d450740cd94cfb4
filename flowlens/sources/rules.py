"""Rules: a small subset of YAML (nested keys, lists of scalars, comments)."""

from __future__ import annotations

import re

TRUE, FALSE, NONE = ("true", "yes", "on"), ("false", "no", "off"), ("null", "none", "~", "")


class RulesError(ValueError):
    """Says the line."""


def scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    low = text.lower()
    if low in TRUE or low in FALSE:
        return low in TRUE
    if low in NONE:
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _bare(line: str) -> str:
    """Without a comment; # within quotes stays."""
    return re.sub(r"""((?:"[^"]*"|'[^']*'|[^#"'])*)#.*""", r"\1", line).rstrip()


def parse(text: str) -> dict:
    lines = [(n, len(b) - len(b.lstrip()), b.strip()) for n, line in enumerate(text.splitlines(), 1) if (b := _bare(line)).strip()]

    def block(i: int, indent: int) -> tuple[object, int]:
        if lines[i][2].startswith("- "):
            items = []
            while i < len(lines) and lines[i][1] == indent and lines[i][2].startswith("- "):
                items.append(scalar(lines[i][2][2:]))
                i += 1
            return items, i
        out: dict = {}
        while i < len(lines) and lines[i][1] == indent:
            n, _, line = lines[i]
            key, colon, value = line.partition(":")
            if not colon or line.startswith("-"):
                raise RulesError(f"line {n}: a key with a colon is needed")
            if value.strip():
                out[str(scalar(key))], i = scalar(value), i + 1
            elif i + 1 < len(lines) and (lines[i + 1][1] > indent or lines[i + 1][1] == indent and lines[i + 1][2].startswith("- ")):
                out[str(scalar(key))], i = block(i + 1, lines[i + 1][1])
            else:
                out[str(scalar(key))], i = None, i + 1
        return out, i

    if not lines:
        return {}
    value, end = block(0, lines[0][1])
    if end < len(lines):
        raise RulesError(f"line {lines[end][0]}: indentation doesn't fit")
    return value if isinstance(value, dict) else {"items": value}


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())
