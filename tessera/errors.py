"""Errors of the engine, each with one of ten codes."""

from __future__ import annotations

# The error codes.
CODES = ("schema", "type", "unsupported", "conflict", "state", "format", "io", "constraint", "cancelled", "resource")


class EngineError(Exception):
    """An error with a code."""

    def __init__(self, code: str, message: str):
        if code not in CODES:
            raise ValueError(code)
        super().__init__(f"{code}: {message}")
        self.code = code
