"""Validation and small driver-side helpers."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from typing import Any

from ..errors import DimMismatch, EmptyVector, EncodingError, ParseError

NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")


def validate_name(name: str) -> str:
    if not NAME.fullmatch(name):
        raise ParseError(f"invalid collection name: {name!r}")
    return name


def check_vector(vector: Sequence[float], dim: int) -> None:
    if not len(vector):
        raise EmptyVector
    if len(vector) != dim:
        raise DimMismatch(dim, len(vector))


def check_id(value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < 1 << 63:
        raise ParseError(f"id must be an integer from 0 to 2**63 - 1: {value!r}")
    return value


def check_top_k(k: Any) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or not 0 <= k < 1 << 31:
        raise ParseError(f"top_k must be an integer from 0 to 2**31 - 1: {k!r}")
    return k


def crc32(data: bytes) -> int:
    return zlib.crc32(data)


def version_of(data: bytes) -> str:
    """Version string of an object's bytes."""
    return f"{zlib.crc32(data):08x}-{len(data)}"


def validate_key(key: str) -> str:
    if not key or key.startswith("/") or ".." in key.split("/"):
        raise ParseError(f"invalid object key: {key!r}")
    return key


def parse_vector(text: str) -> list[float]:
    """Comma-separated numbers, in brackets or not; empty parts are skipped."""
    inner = text.strip()
    if inner.startswith("[") and inner.endswith("]"):
        inner = inner[1:-1]
    try:
        found = [float(x) for part in inner.split(",") if (x := part.strip())]
    except ValueError as e:
        raise ParseError(f"invalid vector: {e}") from None
    if not found:
        raise EmptyVector
    return found


def parse_metadata(text: str) -> Any:
    """Any JSON document; blank text is an empty object."""
    if not text.strip():
        return {}
    try:
        return load_json(text)
    except ValueError as e:
        raise ParseError(f"invalid metadata: {e}") from None


def load_json(text: str) -> Any:
    """Strict JSON: no NaN, no Infinity, no number that overflows."""

    def refuse(x: str):
        raise ValueError(f"not a JSON number: {x}")

    def number(x: str) -> float:
        value = float(x)
        if value in (float("inf"), float("-inf")):
            raise ValueError(f"number out of range: {x}")
        return value

    return json.loads(text, parse_constant=refuse, parse_float=number)


def dump_json(value: Any) -> str:
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    except (TypeError, ValueError) as e:
        raise EncodingError(f"metadata is not JSON: {e}") from None
