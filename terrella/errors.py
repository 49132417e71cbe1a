"""Structured errors: every failure carries a stable code and details."""

from __future__ import annotations

from typing import Any


class EngineError(Exception):
    """Base of all errors of the engine."""

    def __init__(self, message: str, *, code: str = "engine_error", details: dict[str, Any] | None = None):
        super().__init__(message)
        self.code = code
        self.details = dict(details or {})


class GridError(EngineError):
    """Grids differ or are malformed."""


class DTypeError(EngineError):
    """A dtype cannot hold or produce what is asked."""


class UnitError(EngineError):
    """Units are missing or do not match."""


class OperationError(EngineError):
    """An argument of an operator is not acceptable, or a value is outside its domain."""


class StorageError(EngineError):
    """A source or sink is missing, incomplete or in the way."""
