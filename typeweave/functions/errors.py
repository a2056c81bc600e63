"""Errors of the graph engine, each a kind of the built-in exception that callers catch."""

from __future__ import annotations


class GraphTypeError(TypeError):
    """A type or term does not fit where it stands."""


class PatternError(ValueError):
    """A pattern, schema, name or query that can't be read or carried out."""


class MissingError(KeyError):
    """A variable, constant, node, edge, type or term that isn't there, or is there already."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""
