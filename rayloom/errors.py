"""Errors that callers tell apart."""

from __future__ import annotations


class CommandError(ValueError):
    """An error with a code: invalidInput, notFound, conflict, cancelled, cacheCorrupted or internal."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.recoverable = code, code != "internal"
