"""What a benchmark has done so far."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from ..errors import CheckpointError
from .output import replace_json


@dataclass
class Checkpoint:
    graph_path: str
    queries_file: str
    algorithms: list[str]
    completed: dict[int, list[str]] = field(default_factory=dict)
    version: int = 1

    @staticmethod
    def load(path: str) -> Checkpoint | None:
        """None if there is no such file."""
        if not os.path.exists(path):
            return None
        try:
            with open(path, encoding="utf-8") as f:
                body = json.load(f)
            return Checkpoint(body["graph_path"], body["queries_file"], body["algorithms"], {c["query_index"]: c["algorithms_done"] for c in body["completed"]}, body["version"])
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise CheckpointError(f"can't read checkpoint {path}: {e}") from e

    def validate(self, graph_path: str, queries_file: str, algorithms: list[str]) -> None:
        """The run must be over the same graph and queries, with the same algorithms in any order."""
        for what, here, now in (("graph_path", self.graph_path, graph_path), ("queries_file", self.queries_file, queries_file), ("algorithms", sorted(set(self.algorithms)), sorted(set(algorithms)))):
            if here != now:
                raise CheckpointError(f"{what}: the checkpoint has {here!r}, this run {now!r}")

    def done(self, query_index: int, algorithm: str) -> bool:
        return algorithm in self.completed.get(query_index, [])

    def mark_and_save(self, query_index: int, algorithm: str, path: str) -> None:
        of = self.completed.setdefault(query_index, [])
        if algorithm not in of:
            of.append(algorithm)
        body = {"version": self.version, "graph_path": self.graph_path, "queries_file": self.queries_file, "algorithms": self.algorithms, "completed": [{"query_index": k, "algorithms_done": v} for k, v in sorted(self.completed.items())]}
        replace_json(path, body)
