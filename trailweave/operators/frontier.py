"""The frontier evaluator: the distinct targets of a path, by a breadth-first search over vertices and automaton states."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PathGraph
from ..plans.ast import PathQuery
from ..plans.automaton import Automaton, automaton
from ..plans.rules import backward, simplified
from ..storage import Parts, dropped, written
from . import fixpoint
from .components import labelled
from .relational import check_labels, resolved


@dataclass(frozen=True)
class Targets:
    """The result: distinct ids (t)."""

    graph: PathGraph
    rows: DataFrame

    @cached_property
    def result_count(self) -> int:
        return self.rows.count()

    def indices(self) -> list[int]:
        """The ids, in order, on the driver."""
        return sorted(r["t"] for r in self.rows.collect())

    def named(self) -> DataFrame:
        """(target) names."""
        return self.graph.with_names(self.rows.select(F.col("t").alias("target")), "target")


@dataclass
class Prepared:
    graph: PathGraph
    machine: Automaton
    back: Automaton
    subject: int | None
    object: int | None
    most: int | None = None

    def execute(self) -> Targets:
        spark = self.graph.spark
        one = lambda n: spark.range(1).select(F.lit(n).cast("long").alias("v"))
        if self.object is not None and self.subject is None:
            # a search from the object over turned edges; the object is a target if any source is met
            met = search(self.graph, self.back, one(self.object), turned=True, most=self.most)
            return Targets(self.graph, met.limit(1).select(F.lit(self.object).cast("long").alias("t")))
        found = search(self.graph, self.machine, None if self.subject is None else one(self.subject), most=self.most)
        if self.object is not None:
            found = found.where(F.col("v") == self.object)
        return Targets(self.graph, found.select(F.col("v").alias("t")))


def search(graph: PathGraph, machine: Automaton, seeds: DataFrame | None, turned: bool = False, most: int | None = None) -> DataFrame:
    """(v): the vertices at which a path of the automaton ends that starts at one of the seeds, or at any vertex. It runs jobs at once. Up to `most` edges of the path's labels, by default fixpoint.LOCAL_PAIRS, are searched by one task. Of more, only those count that are connected to the seeds."""
    moves = machine.by_label()
    edges = graph.edges.where(F.col("label").isin(*moves)).select("label", *((F.col("dst").alias("s"), F.col("src").alias("t")) if turned else (F.col("src").alias("s"), F.col("dst").alias("t"))))
    held = written(edges, "edges")
    number, most = held.count(), fixpoint.LOCAL_PAIRS if most is None else most
    if number > most and seeds is not None:
        held = _near(held, seeds)
        number = held.count()
    if number <= most:
        ends = _local(machine, held.toArrow(), seeds, graph.spark)
    else:
        ends = _rounds(machine, held, seeds)
    dropped(held)
    if machine.start in machine.finals:  # the empty path
        ends = ends.union(graph.vertices.select(F.col("id").alias("v")) if seeds is None else seeds).distinct()
    return ends


def _near(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The edges (s, t, label) of components with a seed, in place of all of them, which are dropped: a search by rounds would read the others in every round."""
    parts = labelled(edges)
    of = parts.join(seeds.select(F.col("v").alias("s")), "s", "left_semi").select("c").distinct()
    near = parts.join(of, "c", "left_semi").select("s").distinct()
    out = written(edges.join(near, "s", "left_semi").select(*edges.columns), "edges")
    dropped(parts)
    dropped(edges)
    return out


def _local(machine: Automaton, edges: pa.Table, seeds: DataFrame | None, spark: SparkSession) -> DataFrame:
    """One task holds the edges and which vertices each state has seen. Only paths with an edge are searched."""
    everywhere = seeds is None
    ids, flat = np.unique(np.concatenate([edges.column("s").to_numpy(), edges.column("t").to_numpy()]), return_inverse=True)
    s, t = flat[: edges.num_rows], flat[edges.num_rows :]
    label = np.array(edges.column("label").to_pylist(), object)
    parts = {name: (s[label == name], t[label == name]) for name in machine.by_label()}
    shared = spark.sparkContext.broadcast((ids, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = shared.value
        n = len(ids)
        graphs = {}
        for name, (a, b) in parts.items():
            order = np.argsort(a, kind="stable")
            graphs[name] = (b[order], np.searchsorted(a[order], np.arange(n + 1)))
        seen = np.zeros((machine.states, n), bool)
        for batch in batches:
            v = batch.column(0).to_numpy()
            at = np.searchsorted(ids, v)
            at = np.minimum(at, max(0, n - 1))
            known = ids[at] == v if n else np.zeros(len(v), bool)
            seen[machine.start, slice(None) if everywhere else at[known]] = True
        fresh = {machine.start: np.flatnonzero(seen[machine.start])}
        out_of = {}
        for a, name, b in machine.moves:
            out_of.setdefault(a, []).append((name, b))
        while fresh:
            ahead: dict[int, list[np.ndarray]] = {}
            for q, at in fresh.items():
                for name, b in out_of.get(q, []):
                    to, starts = graphs[name]
                    sizes = starts[at + 1] - starts[at]
                    if total := int(sizes.sum()):
                        ahead.setdefault(b, []).append(to[np.repeat(starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)])
            fresh = {}
            for b, lists in ahead.items():
                at = np.unique(np.concatenate(lists))
                at = at[~seen[b, at]]
                if len(at):
                    seen[b, at] = True
                    fresh[b] = at
        hit = seen[sorted(machine.finals - {machine.start})].any(axis=0) if machine.finals - {machine.start} else np.zeros(n, bool)
        yield pa.RecordBatch.from_arrays([pa.array(ids[hit], pa.int64())], names=["v"])

    return (spark.range(1).select(F.col("id").alias("v")) if everywhere else seeds).coalesce(1).mapInArrow(run, "v long")


def _rounds(machine: Automaton, edges: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """Rounds of joins: the frontier (v, q) moves over edges and automaton at once, and what was seen before is dropped. A round reads only the edges that its states can move over. No move leads back to the start, so a search from every vertex begins with what its moves lead to."""
    spark = edges.sparkSession
    moves = spark.createDataFrame([(a, name, b) for a, name, b in machine.moves], "q int, label string, q2 int")
    steps = written(edges.join(F.broadcast(moves), "label").select("q", F.col("s").alias("v"), "q2", F.col("t").alias("v2")), "steps", by="q")
    states = {machine.start}
    if seeds is None:
        fresh = steps.where(F.col("q") == machine.start).select(F.col("v2").alias("v"), F.col("q2").alias("q")).distinct()
        states = {b for a, _, b in machine.moves if a in states}
    else:
        fresh = seeds.select("v", F.lit(machine.start).alias("q")).distinct()
    fresh = written(fresh, "frontier")
    seen = Parts(fresh, "frontier")
    while fresh.take(1):
        ahead = {b for a, _, b in machine.moves if a in states}
        step = fresh.join(steps.where(F.col("q").isin(*states)), ["v", "q"]).select(F.col("v2").alias("v"), F.col("q2").alias("q")).distinct()
        fresh = written(step.join(seen.whole().where(F.col("q").isin(*ahead)), ["v", "q"], "left_anti"), "frontier")
        seen.add(fresh)
        states = ahead
    dropped(steps)
    return seen.whole().where(F.col("q").isin(*(machine.finals - {machine.start}))).select("v").distinct()


class FrontierEvaluator:
    """Targets of a query. The subject is looked up first, then the object, then the labels."""

    name = "nfarpq"

    def __init__(self, local_pairs: int | None = None):
        self.local_pairs = local_pairs

    def prepare(self, query: PathQuery, graph: PathGraph) -> Prepared:
        subject, target = resolved(query.subject, graph), resolved(query.object, graph)
        check_labels(query.path, graph)
        path = simplified(query.path)
        return Prepared(graph, automaton(path), automaton(backward(path)), subject, target, self.local_pairs)

    def evaluate(self, query: PathQuery, graph: PathGraph) -> Targets:
        return self.prepare(query, graph).execute()
