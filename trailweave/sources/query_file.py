"""Query files: a line is an id, a comma and a path pattern."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import QueryError, UnsupportedPath
from ..plans.ast import PathQuery
from ..sparql import parse_query


@dataclass(frozen=True)
class LoadedQuery:
    id: str
    text: str
    parsed: PathQuery | QueryError


def load_queries(path: str, base: str | None = None) -> list[LoadedQuery]:
    """The queries of a file. Empty lines don't count; a line without a comma has the id "?" and an error of its own."""
    out = []
    with open(path, encoding="utf-8") as lines:
        for line in map(str.strip, lines):
            if not line:
                continue
            name, comma, pattern = line.partition(",")
            if not comma:
                out.append(LoadedQuery("?", line, UnsupportedPath(f"the line has no comma: {line!r}")))
                continue
            pattern = pattern.strip()
            prologue = f"BASE <{base}> " if base is not None else ""
            try:
                parsed: PathQuery | QueryError = parse_query(f"{prologue}SELECT * WHERE {{ {pattern} . }}")
            except QueryError as e:
                parsed = e
            out.append(LoadedQuery(name.strip(), pattern, parsed))
    return out
