"""Errors, one class for each kind of failure that a caller may want to tell apart."""

from __future__ import annotations


class TrailError(Exception):
    """Any error of this library."""


class FormatError(TrailError):
    """A source can't be read as the format it is said to be in."""


class MissingColumn(FormatError):
    def __init__(self, name: str):
        super().__init__(f"column '{name}' is missing")
        self.name = name


class InvalidFormat(FormatError):
    def __init__(self, file: str, line: int | None, reason: str):
        super().__init__(f"{file}{'' if line is None else f', line {line}'}: {reason}")
        self.file, self.line, self.reason = file, line, reason


class LiteralAsNode(FormatError):
    def __init__(self):
        super().__init__("a literal can't be a node")


class GraphLoadError(TrailError):
    """A graph couldn't be loaded."""


class QueryError(TrailError):
    """A query can't be parsed or evaluated."""


class SyntaxProblem(QueryError):
    def __init__(self, reason: str, at: int | None = None):
        super().__init__(reason if at is None else f"{reason} (at character {at})")


class ExtractError(QueryError):
    """A query is valid, but isn't one path between two endpoints."""


class NotSelect(ExtractError):
    def __init__(self):
        super().__init__("only SELECT queries are supported")


class NotSinglePath(ExtractError):
    def __init__(self):
        super().__init__("the WHERE clause must be one triple or property path")


class UnsupportedSubject(ExtractError):
    def __init__(self, term: str):
        super().__init__(f"unsupported subject or object: {term}")


class VariablePredicate(ExtractError):
    def __init__(self):
        super().__init__("the predicate of a triple must be an IRI")


class UnsupportedPath(QueryError):
    """A path has a form that an evaluator doesn't take."""


class LabelNotFound(QueryError):
    def __init__(self, label: str):
        super().__init__(f"label not found: {label}")
        self.label = label


class VertexNotFound(QueryError):
    def __init__(self, name: str):
        super().__init__(f"vertex not found: {name}")
        self.name = name


class CheckpointError(TrailError):
    """A benchmark's checkpoint can't be read, or belongs to another run."""


class BenchError(TrailError):
    """A benchmark can't be run as it was asked for."""
