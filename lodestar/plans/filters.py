"""The filter language: comparisons of a top-level metadata field with a literal, joined by AND.

A filter is a small tree that prints as text, parses from text and compiles to a boolean
Column over VARIANT metadata. A comparison is false where the field is missing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..errors import ParseError, Unsupported

OPERATORS = ("!=", "<=", ">=", "=", "<", ">")
_TOKEN = re.compile(
    r"""(?P<space>[ \t\n\r]+)
      | (?P<op>!=|<=|>=|=|<|>)
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<number>-?[0-9.]*)""",
    re.VERBOSE,
)
_ESCAPE = {'"': '"', "\\": "\\", "n": "\n", "t": "\t", "r": "\r"}
_PRINT = {v: "\\" + k for k, v in _ESCAPE.items()}
_WORDS = {"true": True, "false": False, "null": None}


def is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


class Filter:
    """Base of And and Compare; also the constructors."""

    @staticmethod
    def eq(name: str, value: Any) -> Compare:
        return Compare(name, "=", value)

    @staticmethod
    def ne(name: str, value: Any) -> Compare:
        return Compare(name, "!=", value)

    @staticmethod
    def lt(name: str, value: Any) -> Compare:
        return Compare(name, "<", value)

    @staticmethod
    def gt(name: str, value: Any) -> Compare:
        return Compare(name, ">", value)

    @staticmethod
    def lte(name: str, value: Any) -> Compare:
        return Compare(name, "<=", value)

    @staticmethod
    def gte(name: str, value: Any) -> Compare:
        return Compare(name, ">=", value)

    @staticmethod
    def all_of(*terms: Filter) -> And:
        return And(tuple(terms))

    @staticmethod
    def parse(text: str) -> Filter:
        return _parse(text)

    def column(self, variant: Column, metadata: Column | None = None) -> Column:
        """The predicate over a VARIANT column; the JSON text is needed for array and object literals."""
        raise NotImplementedError

    def matches(self, document: Any) -> bool:
        """The same on a Python value; for single documents and as a model in tests."""
        raise NotImplementedError


@dataclass(frozen=True)
class And(Filter):
    terms: tuple[Filter, ...]

    def __str__(self) -> str:
        return " AND ".join(map(str, self.terms))

    def column(self, variant: Column, metadata: Column | None = None) -> Column:
        out = F.lit(True)
        for t in self.terms:
            out = out & t.column(variant, metadata)
        return out

    def matches(self, document: Any) -> bool:
        return all(t.matches(document) for t in self.terms)


@dataclass(frozen=True)
class Compare(Filter):
    name: str
    op: str
    value: Any

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ParseError(f"unknown operator {self.op!r}")

    def __str__(self) -> str:
        v = self.value
        text = '"' + "".join(_PRINT.get(c, c) for c in v) + '"' if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return f"{self.name} {self.op} {text}"

    def column(self, variant: Column, metadata: Column | None = None) -> Column:
        x = F.try_variant_get(variant, self._path(), "variant")
        if self.op == "=":
            return self._equal(x, variant, metadata)
        if self.op == "!=":
            return x.isNotNull() & ~self._equal(x, variant, metadata)
        if not is_number(self.value):
            return F.lit(False)
        left, right = self._number(x, variant), F.lit(float(self.value))
        compared = {"<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[self.op]
        return F.coalesce(compared, F.lit(False))

    def _path(self) -> str:
        if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", self.name):
            return f"$.{self.name}"
        for quote in "'\"":
            if quote not in self.name and "\\" not in self.name:
                return f"$[{quote}{self.name}{quote}]"
        raise Unsupported(f"field name {self.name!r} has both kinds of quotes or a backslash")

    def _number(self, x: Column, variant: Column) -> Column:
        """The value as a double where it is a JSON number; a string or boolean is never cast."""
        kind = F.schema_of_variant(x)
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return F.when(number, F.try_variant_get(variant, self._path(), "double"))

    def _equal(self, x: Column, variant: Column, metadata: Column | None) -> Column:
        v = self.value
        if v is None:
            return F.coalesce(F.is_variant_null(x), F.lit(False))
        if isinstance(v, bool):
            same = (F.schema_of_variant(x) == "BOOLEAN") & (F.try_variant_get(variant, self._path(), "boolean") == F.lit(v))
        elif isinstance(v, str):
            same = (F.schema_of_variant(x) == "STRING") & (F.try_variant_get(variant, self._path(), "string") == F.lit(v))
        elif is_number(v):
            same = self._number(x, variant) == F.lit(float(v))
        else:
            if metadata is None:
                raise Unsupported("an array or object literal needs the metadata text")
            same = _deep_equal(self.name, v)(metadata)
        return F.coalesce(same, F.lit(False))

    def matches(self, document: Any) -> bool:
        if not isinstance(document, dict) or self.name not in document:
            return False
        x, v = document[self.name], self.value
        if self.op in ("=", "!="):
            same = float(x) == float(v) if is_number(x) and is_number(v) else strictly_equal(x, v)
            return same == (self.op == "=")
        if not (is_number(x) and is_number(v)):
            return False
        x, v = float(x), float(v)
        return {"<": x < v, ">": x > v, "<=": x <= v, ">=": x >= v}[self.op]


def strictly_equal(a: Any, b: Any) -> bool:
    """JSON equality in which types count: 1, 1.0 and true all differ."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(strictly_equal(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(strictly_equal, a, b))
    return a == b


def _deep_equal(name: str, value: Any):
    """An Arrow-batched predicate on the JSON text; only for array and object literals."""
    @F.pandas_udf(BooleanType())
    def same(texts: pd.Series) -> pd.Series:
        def one(t):
            doc = json.loads(t) if t is not None else None
            return isinstance(doc, dict) and name in doc and strictly_equal(doc[name], value)

        return texts.map(one).astype(bool)

    return same


def _tokens(text: str) -> Iterator[tuple[str, Any, int]]:
    at = 0
    while at < len(text):
        if text[at] == '"':
            value, end = _string(text, at)
            yield "value", value, at
            at = end
            continue
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ParseError(f"at position {at}: unexpected {text[at]!r}")
        kind, found = m.lastgroup, m.group()
        if kind == "op":
            yield "op", found, at
        elif kind == "word":
            if found.lower() == "and":
                yield "and", found, at
            elif found in _WORDS:
                yield "value", _WORDS[found], at
            else:
                yield "name", found, at
        elif kind == "number":
            yield "value", _number(found, at), at
        at = m.end()
    yield "end", None, at


def _number(text: str, at: int) -> int | float:
    if text[0] == ".":
        raise ParseError(f"at position {at}: a number starts with a digit")
    try:
        value = float(text)
    except ValueError:
        raise ParseError(f"at position {at}: invalid number {text!r}") from None
    if value in (float("inf"), float("-inf")):
        raise ParseError(f"at position {at}: number out of range")
    return int(value) if value.is_integer() and abs(value) < 2.0**63 else value


def _string(text: str, at: int) -> tuple[str, int]:
    out, i = [], at + 1
    while i < len(text):
        c = text[i]
        if c == '"':
            return "".join(out), i + 1
        if c == "\\":
            i += 1
            if i >= len(text) or text[i] not in _ESCAPE:
                raise ParseError(f"at position {i}: invalid escape")
            c = _ESCAPE[text[i]]
        out.append(c)
        i += 1
    raise ParseError(f"at position {at}: string without an end")


def _parse(text: str) -> Filter:
    tokens = _tokens(text)

    def take(kind: str) -> Any:
        got, value, at = next(tokens)
        if got != kind:
            raise ParseError(f"at position {at}: expected {kind}, found {got}")
        return value

    terms = []
    while True:
        terms.append(Compare(take("name"), take("op"), take("value")))
        kind, _, at = next(tokens)
        if kind == "end":
            return terms[0] if len(terms) == 1 else And(tuple(terms))
        if kind != "and":
            raise ParseError(f"at position {at}: expected AND or the end")
