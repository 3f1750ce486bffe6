"""Results of query and benchmark runs, as JSON."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field


@dataclass
class Outcome:
    """Of one algorithm on one query. What is None is left out of the JSON."""

    status: str
    error: str | None = None
    result_count: int | None = None
    timing: dict | None = None

    def as_json(self) -> dict:
        return {k: v for k, v in vars(self).items() if v is not None}


@dataclass
class QueryResult:
    query_index: int
    query_id: str
    query_text: str
    algorithms: dict[str, Outcome] = field(default_factory=dict)

    def as_json(self) -> dict:
        return vars(self) | {"algorithms": {k: v.as_json() for k, v in self.algorithms.items()}}


def write_json(path: str, metadata: dict, results: list[QueryResult]) -> None:
    body = {"metadata": {k: v for k, v in metadata.items() if v is not None}, "results": [r.as_json() for r in results]}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(body, f, indent=2)


def replace_json(path: str, body: dict) -> None:
    """Writes a file beside `path` and puts it in its place, so that the old one stays whole if the run ends meanwhile."""
    beside = f"{path}.tmp"
    with open(beside, "w", encoding="utf-8") as f:
        json.dump(body, f, indent=2)
    os.replace(beside, path)
