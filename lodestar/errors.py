"""Errors of the engine; each has the HTTP status and code under which the server reports it."""

from __future__ import annotations


class LodestarError(Exception):
    status, code = 500, "internal_error"


class CorruptError(LodestarError):
    """A committed file is missing, damaged or inconsistent."""


class EncodingError(LodestarError):
    """A value cannot be stored."""


class CollectionNotFound(LodestarError):
    status, code = 404, "not_found"

    def __init__(self, name: str):
        super().__init__(f"collection not found: {name}")


class CollectionExists(LodestarError):
    status, code = 409, "conflict"

    def __init__(self, name: str):
        super().__init__(f"collection already exists: {name}")


class ConflictError(LodestarError):
    """A conditional write found another version."""

    status, code = 409, "conflict"


class DimMismatch(LodestarError):
    status, code = 400, "invalid_request"

    def __init__(self, expected: int, got: int):
        super().__init__(f"dimension mismatch: expected {expected}, got {got}")
        self.expected, self.got = expected, got


class EmptyVector(LodestarError):
    status, code = 400, "invalid_request"

    def __init__(self):
        super().__init__("vector must not be empty")


class ParseError(LodestarError):
    status, code = 400, "invalid_request"


class Unsupported(LodestarError):
    status, code = 400, "invalid_request"
