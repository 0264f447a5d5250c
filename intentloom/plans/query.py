"""The query language: text to a Query.

query = form ["*"] "(" argument ")" filter*; arguments are dotted names or quoted strings. Errors say what was expected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .. import schema


class QueryError(ValueError):
    pass


STAR_FORMS = ["affects", "reads", "touches", "callers", "callees", "depends", "dependents"]
NAME_FORMS = [*STAR_FORMS, "emits", "handlers", "reaches", "show"]
TEXT_FORMS = ["tagged", "owner"]
FORMS = [*NAME_FORMS, *TEXT_FORMS, "path", "unknown"]


@dataclass(frozen=True)
class Filter:
    """what: module, service, owned_by or kind."""

    what: str
    value: str


@dataclass(frozen=True)
class Query:
    form: str
    args: tuple[str, ...] = ()
    star: bool = False
    #: of unknown: (kind, name)
    scope: tuple[str, str] | None = None
    filters: tuple[Filter, ...] = field(default=())


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(word: str, words: list[str]) -> str:
    return min(words, key=lambda w: (distance(word, w), w))


_TOKEN = re.compile(r'\s*(?:([^\W\d]\w*)|"((?:[^"\\]|\\.)*)"|([*(),.]))', re.S)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            rest = text[at:].lstrip()
            raise QueryError("a string isn't closed" if rest[:1] == '"' else f"{rest[:1]!r} has no meaning here")
        word, string, sign = m.groups()
        out.append(("word", word) if word else ("text", re.sub(r'\\(["\\])', r"\1", string)) if string is not None else ("sign", sign))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "the end")

    def take(self, kind: str, value: str | None = None, wanted: str = "") -> str:
        k, v = self.peek()
        if k != kind or value is not None and v != value:
            raise QueryError(f"expected {wanted or value or kind}, found {v!r}")
        self.at += 1
        return v

    def takes(self, kind: str, value: str) -> bool:
        if self.peek() == (kind, value):
            self.at += 1
            return True
        return False

    def name(self) -> str:
        parts = [self.take("word", wanted="a name")]
        while self.takes("sign", "."):
            parts.append(self.take("word", wanted="a name after the dot"))
        return ".".join(parts)

    def within(self, read):
        self.take("sign", "(")
        value = read()
        self.take("sign", ")")
        return value

    def string(self) -> str:
        return self.take("text", wanted="a quoted string")

    def filter(self) -> Filter:
        word = self.take("word", wanted="a filter")
        if word == "in":
            kind = self.take("word", wanted="module or service")
            if kind not in ("module", "service"):
                raise QueryError(f"in takes module or service, not {kind}")
            return Filter(kind, self.within(self.name))
        if word == "owned_by":
            return Filter("owned_by", self.within(self.string))
        if word == "kind":
            kind = self.within(lambda: self.take("word", wanted="a kind"))
            if kind not in schema.KINDS:
                raise QueryError(f"{kind} is no kind; there are {', '.join(schema.KINDS)}")
            return Filter("kind", kind)
        raise QueryError(f"{word} is no filter; there are in, owned_by and kind")


def parse(text: str) -> Query:
    r = _Reader(text)
    form = r.take("word", wanted="a query form")
    if form not in FORMS:
        raise QueryError(f"{form} is no query form; did you mean {nearest(form, FORMS)}?")
    star = r.takes("sign", "*")
    if star and form not in STAR_FORMS:
        raise QueryError("reaches is transitive as it is" if form == "reaches" else f"{form} takes no *; {', '.join(STAR_FORMS)} do")
    args, scope = (), None
    if form == "path":
        r.take("sign", "(")
        a = r.name()
        r.take("sign", ",")
        args = (a, r.name())
        r.take("sign", ")")
    elif form == "unknown":
        save = r.at
        if r.takes("word", "in"):
            k, v = r.peek()
            if k == "word" and v in schema.SCOPES:
                r.at += 1
                scope = (v, r.within(r.name))
            else:
                r.at = save
    else:
        args = (r.within(r.name if form in NAME_FORMS else r.string),)
    filters = []
    while r.peek()[0] != "end":
        filters.append(r.filter())
    return Query(form, args, star, scope, tuple(filters))
