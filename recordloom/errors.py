"""Typed failures. Callers branch on ``code``, never on message text."""

from __future__ import annotations


class LoomError(Exception):
    code = "INTERNAL"


class InvalidArgument(LoomError, ValueError):
    code = "INVALID_ARGUMENT"


class Cancelled(LoomError):
    code = "CANCELLED"


class ResourceExhausted(LoomError):
    code = "RESOURCE_EXHAUSTED"

    def __init__(self, message: str, limit: str = "", actual: int = 0, maximum: int = 0):
        super().__init__(message)
        self.limit, self.actual, self.maximum = limit, actual, maximum


class Unsupported(LoomError):
    code = "UNSUPPORTED"


class Contention(LoomError):
    code = "CONTENTION"


class NotFound(LoomError, KeyError):
    code = "NOT_FOUND"


class Corruption(LoomError):
    code = "CORRUPTION"


class Erased(Corruption):
    """The bytes were destroyed on purpose: neither absent nor damaged."""


class IoFailure(LoomError, OSError):
    code = "IO"


class BudgetTooSmall(ResourceExhausted):
    """No eligible run of parts fits; ``needed_*`` is what the cheapest pair takes."""

    def __init__(self, needed_rows: int, needed_bytes: int):
        super().__init__(f"the cheapest pair of parts has {needed_rows} rows and {needed_bytes} bytes")
        self.needed_rows, self.needed_bytes = needed_rows, needed_bytes


def classify(error: BaseException) -> str:
    """The code of any exception, Spark's included."""
    if isinstance(error, LoomError):
        return error.code
    name = type(error).__name__
    if name in ("ParseException", "AnalysisException", "IllegalArgumentException") or isinstance(error, ValueError | TypeError):
        return "INVALID_ARGUMENT"
    if isinstance(error, FileNotFoundError | KeyError):
        return "NOT_FOUND"
    if isinstance(error, OSError):
        return "IO"
    if isinstance(error, MemoryError):
        return "RESOURCE_EXHAUSTED"
    return "INTERNAL"
