"""Typed document filters: a small language, its tree, and the column it stands for.

A missing source, number or date never matches a leaf, and NOT matches whatever its operand does not, missing values too.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MAX_SOURCE_BYTES, MAX_TAG_BYTES, MAX_TAGS
from ..errors import invalid

MAX_BYTES, MAX_NODES, MAX_LEVELS = 16 << 10, 256, 32


@dataclass(frozen=True)
class Source:
    value: str


@dataclass(frozen=True)
class Tag:
    value: str


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Range:
    """field of numbers (kind "number") or dates; bounds are (value, included) or None."""

    kind: str
    field: str
    lower: tuple | None = None
    upper: tuple | None = None


def parse_date(text: str) -> date:
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        raise invalid(f"bad date {text!r}")
    try:
        return date.fromisoformat(text)
    except ValueError:
        raise invalid(f"bad date {text!r}") from None


def finite(value: float) -> float:
    if not math.isfinite(value):
        raise invalid("numbers must be finite")
    return value + 0.0  # -0.0 becomes 0.0


def validate(expr, level: int = 1) -> int:
    """Number of nodes; raises if the tree is too large or a value is not allowed."""
    if level > MAX_LEVELS + 1:
        raise invalid(f"filter exceeds {MAX_LEVELS} levels")
    nodes = 1
    if isinstance(expr, And | Or):
        nodes += sum(validate(p, level + 1) for p in expr.parts)
    elif isinstance(expr, Not):
        nodes += validate(expr.part, level + 1)
    elif isinstance(expr, Source | Tag | Range):
        text, most = (expr.value, MAX_SOURCE_BYTES if isinstance(expr, Source) else MAX_TAG_BYTES) if not isinstance(expr, Range) else (expr.field, MAX_TAG_BYTES)
        if not 1 <= len(text.encode()) <= most or "\0" in text:
            raise invalid(f"{text[:40]!r} must have 1 to {most} bytes without NUL")
        if isinstance(expr, Range):
            for bound in filter(None, (expr.lower, expr.upper)):
                if expr.kind == "number":
                    finite(bound[0])
            if expr.lower and expr.upper and expr.lower[0] > expr.upper[0]:
                raise invalid("the lower bound is above the upper one")
    else:
        raise invalid(f"not a filter: {expr!r}")
    if nodes > MAX_NODES:
        raise invalid(f"filter exceeds {MAX_NODES} nodes")
    return nodes


def column(expr, source: str = "source", tags: str = "tags", numbers: str = "numbers", dates: str = "dates") -> Column:
    """The tree as a two-valued column; attributes are looked up in maps."""
    validate(expr)
    false = F.lit(False)

    def build(e) -> Column:
        if isinstance(e, And):
            return reduce(lambda a, b: a & b, map(build, e.parts), F.lit(True))
        if isinstance(e, Or):
            return reduce(lambda a, b: a | b, map(build, e.parts), false)
        if isinstance(e, Not):
            return ~build(e.part)
        if isinstance(e, Source):
            return F.coalesce(F.col(source) == e.value, false)
        if isinstance(e, Tag):
            return F.coalesce(F.array_contains(tags, e.value), false)
        value = F.try_element_at(F.col(numbers if e.kind == "number" else dates), F.lit(e.field))
        if e.lower and e.upper and e.lower[0] == e.upper[0] and not (e.lower[1] and e.upper[1]):
            return false
        tests = [value.isNotNull()]
        if e.lower:
            tests.append(value >= F.lit(e.lower[0]) if e.lower[1] else value > F.lit(e.lower[0]))
        if e.upper:
            tests.append(value <= F.lit(e.upper[0]) if e.upper[1] else value < F.lit(e.upper[0]))
        return F.coalesce(reduce(lambda a, b: a & b, tests), false)

    return build(expr)


def document_filter(source: str | None = None, all_tags: tuple[str, ...] = (), expr=None, **columns) -> Column:
    """Source, every tag and the expression together."""
    if len(all_tags) > MAX_TAGS:
        raise invalid(f"more than {MAX_TAGS} tags")
    parts = [*([Source(source)] if source is not None else []), *map(Tag, dict.fromkeys(all_tags)), *([expr] if expr is not None else [])]
    return column(And(tuple(parts)), **columns)


_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_OPERATOR = re.compile(r"[=<>!]+")
_WORD = re.compile(r"[A-Za-z0-9_]+")


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.nodes = text, 0, 0

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t\n\f\r":
            self.at += 1

    def word(self, *names: str) -> str | None:
        self.space()
        found = _WORD.match(self.text, self.at)
        if found and found[0].lower() in names:
            self.at = found.end()
            return found[0].lower()
        return None

    def mark(self, sign: str, must: bool = False) -> bool:
        self.space()
        if self.text.startswith(sign, self.at):
            self.at += 1
            return True
        if must:
            raise invalid(f"expected {sign!r} at {self.at}")
        return False

    def made(self, node):
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise invalid(f"filter exceeds {MAX_NODES} nodes")
        return node

    def chain(self, depth: int, word: str, kind, inner):
        parts = [inner(depth)]
        while self.word(word):
            parts.append(inner(depth))
        return self.made(kind(tuple(parts))) if len(parts) > 1 else parts[0]

    def any_of(self, depth: int):
        return self.chain(depth, "or", Or, lambda d: self.chain(d, "and", And, self.one))

    def one(self, depth: int):
        if depth > MAX_LEVELS:
            raise invalid(f"filter exceeds {MAX_LEVELS} levels")
        if self.word("not"):
            return self.made(Not(self.one(depth + 1)))
        if self.mark("("):
            inner = self.any_of(depth + 1)
            self.mark(")", must=True)
            return inner
        kind = self.word("source", "tag", "number", "date")
        if not kind:
            raise invalid(f"expected a condition at {self.at}")
        self.mark("(", must=True)
        name = self.string()
        self.mark(")", must=True)
        if kind in ("source", "tag"):
            return self.made(Source(name) if kind == "source" else Tag(name))
        self.space()
        found = _OPERATOR.match(self.text, self.at)
        if not found or found[0] not in ("=", "==", "!=", "<", "<=", ">", ">="):
            raise invalid(f"expected a comparison at {self.at}")
        self.at, op = found.end(), found[0]
        value = self.number() if kind == "number" else parse_date(self.string())
        lower = (value, op != ">") if op not in ("<", "<=") else None
        upper = (value, op != "<") if op not in (">", ">=") else None
        leaf = self.made(Range(kind, name, lower, upper))
        return self.made(Not(leaf)) if op == "!=" else leaf

    def number(self) -> float:
        self.space()
        found = re.compile(r"[^\s)]+").match(self.text, self.at)
        if not found or not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", found[0]):
            raise invalid(f"expected a finite number at {self.at}")
        self.at = found.end()
        return finite(float(found[0]))

    def string(self) -> str:
        self.mark('"', must=True)
        units: list[str] = []
        while True:
            if self.at >= len(self.text):
                raise invalid("a string has no end")
            c = self.text[self.at]
            self.at += 1
            if c == '"':
                break
            if c < " ":
                raise invalid("control character in a string")
            if c == "\\":
                e = self.text[self.at : self.at + 1]
                self.at += 1
                if e == "u":
                    code = self.text[self.at : self.at + 4]
                    if not re.fullmatch("[0-9a-fA-F]{4}", code):
                        raise invalid("bad escape")
                    self.at += 4
                    c = chr(int(code, 16))
                elif e in _ESCAPES and e:
                    c = _ESCAPES[e]
                else:
                    raise invalid("bad escape")
            units.append(c)
        try:
            return "".join(units).encode("utf-16", "surrogatepass").decode("utf-16")
        except UnicodeDecodeError:
            raise invalid("lone surrogate in a string") from None


def parse(text: str):
    """NOT binds before AND, AND before OR; words in any case; strings as in JSON."""
    if len(text.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        raise invalid(f"filter exceeds {MAX_BYTES} bytes")
    reader = _Reader(text)
    expr = reader.any_of(0)
    reader.space()
    if reader.at != len(text):
        raise invalid(f"unexpected text at {reader.at}")
    validate(expr)
    return expr
