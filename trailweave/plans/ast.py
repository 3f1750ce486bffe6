"""Path expressions and queries."""

from __future__ import annotations

from dataclasses import dataclass


class Path:
    """A path expression; its parts are compared by value."""


@dataclass(frozen=True)
class Label(Path):
    name: str


@dataclass(frozen=True)
class Sequence(Path):
    left: Path
    right: Path


@dataclass(frozen=True)
class Alternative(Path):
    left: Path
    right: Path


@dataclass(frozen=True)
class ZeroOrMore(Path):
    inner: Path


@dataclass(frozen=True)
class OneOrMore(Path):
    inner: Path


@dataclass(frozen=True)
class ZeroOrOne(Path):
    inner: Path


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Named:
    iri: str


Endpoint = Variable | Named


def labels(path: Path) -> list[str]:
    """The labels of a path from left to right, repeats included."""
    match path:
        case Label(name):
            return [name]
        case Sequence(a, b) | Alternative(a, b):
            return labels(a) + labels(b)
        case ZeroOrMore(p) | OneOrMore(p) | ZeroOrOne(p):
            return labels(p)
    raise TypeError(path)


def has_optional(path: Path) -> bool:
    match path:
        case ZeroOrOne():
            return True
        case Label():
            return False
        case Sequence(a, b) | Alternative(a, b):
            return has_optional(a) or has_optional(b)
        case ZeroOrMore(p) | OneOrMore(p):
            return has_optional(p)
    raise TypeError(path)


def renamed(path: Path, name) -> Path:
    match path:
        case Label(n):
            return Label(name(n))
        case Sequence(a, b):
            return Sequence(renamed(a, name), renamed(b, name))
        case Alternative(a, b):
            return Alternative(renamed(a, name), renamed(b, name))
        case ZeroOrMore(p):
            return ZeroOrMore(renamed(p, name))
        case OneOrMore(p):
            return OneOrMore(renamed(p, name))
        case ZeroOrOne(p):
            return ZeroOrOne(renamed(p, name))
    raise TypeError(path)


@dataclass(frozen=True)
class PathQuery:
    """All pairs (or targets) joined by `path`. Names of variables mean nothing: a variable used twice asks for no equality."""

    subject: Endpoint
    path: Path
    object: Endpoint

    def strip_base(self, base: str) -> PathQuery:
        """The query with a leading `base` taken off its endpoints and labels."""

        def bare(name: str) -> str:
            return name.removeprefix(base)

        def end(e: Endpoint) -> Endpoint:
            return Named(bare(e.iri)) if isinstance(e, Named) else e

        return PathQuery(end(self.subject), renamed(self.path, bare), end(self.object))
