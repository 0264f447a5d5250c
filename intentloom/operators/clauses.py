"""The clause language of a block: ``name: value`` with strings, references, routes and enforcement."""

from __future__ import annotations

import re

from .. import schema
from ..plans.query import nearest

_NAME = r"[^\W\d]\w*"
_REF = re.compile(rf"{_NAME}(?:\.{_NAME})*")
METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH"]


def quoted(text: str) -> str | None:
    """What a string literal says; only an escaped quote or backslash is an escape. None: not one whole literal."""
    m = re.fullmatch(r'"((?:[^"\\]|\\.)*)"', text.strip(), re.S)
    return re.sub(r'\\(["\\])', r"\1", m[1]) if m else None


def is_open(text: str) -> bool:
    """Whether a string begun in ``text`` isn't closed in it."""
    inside = escaped = False
    for c in text:
        if inside and escaped:
            escaped = False
        elif inside and c == "\\":
            escaped = True
        elif c == '"':
            inside = not inside
    return inside


def logical_lines(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Lines with those that end within a string joined to the next."""
    out: list[tuple[int, str]] = []
    for line, text in lines:
        if out and is_open(out[-1][1]):
            out[-1] = (out[-1][0], f"{out[-1][1]}\n{text}")
        else:
            out.append((line, text))
    return out


def _values(name: str, raw: str) -> list[str] | None:
    if name in schema.REFERENCES:
        parts = [p.strip() for p in raw.split(",")]
        return parts if all(_REF.fullmatch(p) for p in parts) else None
    if name == "route":
        m = re.fullmatch(r"(?:([A-Za-z]+)\s+)?(\".*\")", raw.strip(), re.S)
        path = quoted(m[2]) if m else None
        if path is None or m[1] and m[1] not in METHODS:
            return None
        return [f"{m[1]} {path}" if m[1] else path]
    if name == "enforcement":
        return [raw.strip()] if raw.strip() in ("strict", "warn") else None
    value = quoted(raw)
    return None if value is None else [value]


def parse(lines: list[tuple[int, str]]) -> tuple[list[tuple[str, int, str, int]], list[tuple[str, int, str]]]:
    """Clauses (clause, ord, value, line) and findings (code, line, message) of a block's lines (line, text).

    E0202 unknown name, E0206 a second one of what may stand once (the first counts), E0207 malformed; what is wrong
    says nothing.
    """
    out: list[tuple[str, int, str, int]] = []
    wrong: list[tuple[str, int, str]] = []
    for line, text in logical_lines(lines):
        m = re.match(rf"\s*({_NAME})\s*:(.*)$", text, re.S)
        if not m:
            wrong.append(("E0207", line, "not of the form name: value"))
            continue
        name, raw = m[1], m[2]
        if name not in schema.CLAUSE_NAMES:
            wrong.append(("E0202", line, f"{name} is no clause; nearest: {nearest(name, schema.CLAUSE_NAMES)}"))
        elif name in schema.SINGULAR and any(c == name for c, *_ in out):
            wrong.append(("E0206", line, f"a second {name}"))
        elif (values := _values(name, raw)) is None:
            wrong.append(("E0207", line, f"the value of {name} is malformed"))
        else:
            out += [(name, len(out) + i, v, line) for i, v in enumerate(values)]
    return out, wrong
