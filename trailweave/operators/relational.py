"""The relational evaluator: a path's whole set of (source, target) pairs, as a plan of joins and unions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LabelNotFound, UnsupportedPath, VertexNotFound
from ..graph import PathGraph
from ..plans.ast import Alternative, Label, Named, OneOrMore, Path, PathQuery, Sequence, ZeroOrMore, ZeroOrOne, has_optional, labels
from ..plans.rules import backward, nullable, simplified, steps
from ..storage import FEW_PARTS, partitions, read_bytes, written
from .fixpoint import transitive

Sources = int | DataFrame | None

#: Edges of one vertex from which a join of many pairs is left to Spark.
HUB = 1_000_000


def once(pairs: DataFrame, *inputs: DataFrame) -> DataFrame:
    """The pairs without repeats. If much is read, they are dealt out first: before that a task meets few repeats, and would hold all pairs that its join makes, however many."""
    parts = partitions(*inputs)
    return (pairs.repartition(parts, "s", "t") if parts > FEW_PARTS else pairs).distinct()


def closes(path: Path) -> bool:
    """Whether the path has a closure."""
    match path:
        case Sequence(a, b) | Alternative(a, b):
            return closes(a) or closes(b)
        case ZeroOrOne(p):
            return closes(p)
    return not isinstance(path, Label)


class Lowering:
    """Path expressions to DataFrames (s, t), without repeats unless they are a label of a graph whose edges have some. Equal parts are lowered once for the same sources: all, one id, which becomes a filter of the scan, or a DataFrame of them."""

    def __init__(self, graph: PathGraph, turned: bool = False, most: int | None = None):
        self.graph, self.turned, self.most = graph, turned, most
        self.done: dict[tuple[Path, int], DataFrame] = {}
        self.held: list[Sources] = [None]

    def lower(self, path: Path, sources: Sources = None) -> DataFrame:
        for k, of in enumerate(self.held):
            if of is sources:
                break
        else:
            self.held.append(sources)
            k = len(self.held) - 1
        if (path, k) not in self.done:
            self.done[path, k] = self._lower(path, sources)
        return self.done[path, k]

    def rows(self, sources: int | DataFrame) -> DataFrame:
        return self.graph.spark.range(1).select(F.lit(sources).cast("long").alias("s")) if isinstance(sources, int) else sources.select("s")

    def identity(self, sources: Sources) -> DataFrame:
        every = self.graph.vertices.select(F.col("id").alias("s")) if sources is None else self.rows(sources)
        return every.select("s", F.col("s").alias("t"))

    def _lower(self, path: Path, sources: Sources) -> DataFrame:
        match path:
            case Label(name):
                pairs = self.graph.label_edges(name)
                if self.turned:
                    pairs = pairs.select(F.col("t").alias("s"), F.col("s").alias("t"))
                if isinstance(sources, int):
                    return pairs.where(F.col("s") == sources)
                return pairs if sources is None else pairs.join(sources, "s", "left_semi")
            case Sequence() | Alternative():
                found = self.bag(path, sources)
                return once(found, found)
            case OneOrMore(p):
                return self._closure(p, sources)
            case ZeroOrMore(p):
                return self._closure(p, sources).union(self.identity(sources)).distinct()
            case ZeroOrOne(p):
                return self.lower(p, sources).union(self.identity(sources)).distinct()
        raise TypeError(path)

    def bag(self, path: Path, sources: Sources) -> DataFrame:
        """As `lower`, but with repeats, for unions that drop them."""
        match path:
            case Alternative(a, b):
                return self.bag(a, sources).union(self.bag(b, sources))
            case Sequence(ZeroOrMore(p) | ZeroOrOne(p) as a, b) if not isinstance(b, ZeroOrMore | ZeroOrOne):
                # no step of `a`, or some: every vertex joined to itself is never made
                more = Sequence(OneOrMore(p) if isinstance(a, ZeroOrMore) else p, b)
                return self.lower(b, sources).union(self.bag(more, sources))
            case Sequence(a, ZeroOrMore(p) | ZeroOrOne(p) as b):
                left = self.lower(a, sources)
                more = OneOrMore(p) if isinstance(b, ZeroOrMore) else p
                right = self.lower(more, self.ends(left, more))
                return left.union(self.joined(left, right))
            case Sequence(a, b):
                if sources is None and (later := self.rest(path)) is not None:
                    a, b = later
                left = self.lower(a, sources)
                right = self.lower(b, None if sources is None and not closes(b) else self.ends(left, b))
                if min(partitions(left), partitions(right)) > FEW_PARTS and not self.hub(a, b):
                    # many pairs may come of each one, so a task gets few; Spark would split a hub's only if it deals them out itself
                    parts = partitions(left, right)
                    left, right = left.repartition(parts, "t"), right.repartition(parts, "s")
                return self.joined(left, right)
        return self.lower(path, sources)

    def hub(self, a: Path, b: Path) -> bool:
        """Whether HUB edges of the last step of `a` or the first one of `b` meet in one vertex, or may do so."""
        for step, end in ((steps(a)[-1], "t"), (steps(b)[0], "s")):
            if not isinstance(step, Label) or self.lower(step).groupBy(end).count().where(F.col("count") >= HUB).take(1):
                return True
        return False

    def rest(self, path: Sequence) -> tuple[Path, Path] | None:
        """The first step and the others, if it has more edges, or more is read for it, than for them: they are joined first, so that its many pairs are joined once."""
        first, *others = steps(path)
        if len(others) < 2 or isinstance(first, ZeroOrMore | ZeroOrOne):
            return None
        # a label's part of an edge table is counted from the files' footers, while Spark's sizes are those of the whole table
        edges = {name: self.graph.label_edges(name) for name in labels(path)}
        size = {name: e.count() if self.graph.unique else read_bytes(e) for name, e in edges.items()}
        if sum(size[n] for n in labels(first)) <= sum(size[n] for p in others for n in labels(p)):
            return None
        after = others[-1]
        for p in reversed(others[:-1]):
            after = Sequence(p, after)
        return None if nullable(after) else (first, after)

    def ends(self, pairs: DataFrame, after: Path) -> DataFrame:
        """(s): where pairs end and `after` starts; written once if it has a closure, which starts there more than once."""
        found = pairs.select(F.col("t").alias("s")).distinct()
        return written(found, "ends") if closes(after) else found

    def joined(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return left.withColumnRenamed("t", "m").join(right.withColumnRenamed("s", "m"), "m").select("s", "t")

    def _closure(self, p: Path, sources: Sources) -> DataFrame:
        return transitive(self.lower(p), None if sources is None else self.rows(sources), self.most)


@dataclass
class Prepared:
    """A query that is ready to run, again and again: names are resolved and the plan is made, closures excepted."""

    graph: PathGraph
    path: Path
    subject: int | None
    object: int | None
    most: int | None = None

    def execute(self) -> Pairs:
        if self.subject is not None:
            found = Lowering(self.graph, most=self.most).lower(self.path, self.subject)
            if self.object is not None:
                found = found.where(F.col("t") == self.object)
        elif self.object is not None:
            turned = Lowering(self.graph, turned=True, most=self.most).lower(backward(self.path), self.object)
            found = turned.select(F.col("t").alias("s"), F.col("s").alias("t"))
        else:
            found = Lowering(self.graph, most=self.most).lower(self.path)
        if isinstance(self.path, Label) and not self.graph.unique:  # all other forms drop repeats themselves
            found = found.distinct()
        return Pairs(self.graph, found)


@dataclass(frozen=True)
class Pairs:
    """The result: all pairs of ids (s, t)."""

    graph: PathGraph
    rows: DataFrame

    @cached_property
    def nnz(self) -> int:
        """How many pairs there are."""
        return self.rows.count()

    @cached_property
    def result_count(self) -> int:
        """How many distinct targets there are."""
        return self.targets.count()

    @property
    def targets(self) -> DataFrame:
        return self.rows.select("t").distinct()

    def named(self) -> DataFrame:
        """(source, target) names."""
        return self.graph.with_names(self.rows.select(F.col("s").alias("source"), F.col("t").alias("target")), "source", "target")


def check_labels(path: Path, graph: PathGraph) -> None:
    for name in labels(path):
        if name not in graph.labels:
            raise LabelNotFound(name)


def resolved(end, graph: PathGraph) -> int | None:
    if not isinstance(end, Named):
        return None
    node = graph.node_id(end.iri)
    if node is None:
        raise VertexNotFound(end.iri)
    return node


class RelationalEvaluator:
    """Pairs of a query. `p?` is refused unless `optional` allows it; then labels are checked, then the subject, then the object."""

    name = "rpqmatrix"

    def __init__(self, optional: bool = False, local_pairs: int | None = None):
        self.optional, self.local_pairs = optional, local_pairs

    def prepare(self, query: PathQuery, graph: PathGraph) -> Prepared:
        if not self.optional and has_optional(query.path):
            raise UnsupportedPath("zero-or-one paths are not supported by this evaluator")
        check_labels(query.path, graph)
        return Prepared(graph, simplified(query.path), resolved(query.subject, graph), resolved(query.object, graph), self.local_pairs)

    def evaluate(self, query: PathQuery, graph: PathGraph) -> Pairs:
        return self.prepare(query, graph).execute()
