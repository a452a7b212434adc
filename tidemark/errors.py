"""Errors of the engine."""

from __future__ import annotations


class SqlError(ValueError):
    """A statement that cannot be parsed, bound or run; position is where in
    the text, or -1."""

    def __init__(self, message: str, position: int = -1) -> None:
        super().__init__(message if position < 0 else f"{message} (position {position})")
        self.position = position
