"""Edge-labelled graphs as two DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import GraphLoadError
from .storage import FEW_PARTS, dropped, partitions, written

#: Edges that a task joins with the dictionary of names.
TASK_ROWS = 400_000

EDGE_SCHEMA = "source string not null, label string not null, target string not null"


@dataclass(frozen=True)
class PathGraph:
    """A directed graph: `edges` (src, label, dst) and `vertices` (id, name), which may have vertices without an edge. Of several with one name, the greatest id stands for it, or the greatest `at` if they have that column.

    If `edges` may have repeats, `unique` is false; operators then drop them once, at their end. `named` and `numbered`, if given, turn ids into names and back without a join.
    """

    edges: DataFrame
    vertices: DataFrame
    named: Callable[[Column], Column] | None = None
    known_labels: frozenset[str] | None = None
    numbered: Callable[[str], int | None] | None = field(default=None)
    unique: bool = True

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @cached_property
    def labels(self) -> frozenset[str]:
        """All labels; they are few, as each is a relation of its own."""
        if self.known_labels is not None:
            return self.known_labels
        return frozenset(r["label"] for r in self.edges.select("label").distinct().collect())

    def label_edges(self, label: str) -> DataFrame:
        """(s, t) of one label."""
        return self.edges.where(F.col("label") == label).select(F.col("src").alias("s"), F.col("dst").alias("t"))

    def node_id(self, name: str) -> int | None:
        """The id of a vertex; None if there is no such vertex."""
        if self.numbered is not None:
            n = self.numbered(name)
            found = [] if n is None else self.vertices.where(F.col("id") == n).select("id").take(1)
        else:
            found = self.vertices.where(F.col("name") == name).orderBy(F.desc("at" if "at" in self.vertices.columns else "id")).select("id").take(1)
        return found[0]["id"] if found else None

    def node_name(self, node: int) -> str | None:
        found = self.vertices.where(F.col("id") == node).select("name").take(1)
        return found[0]["name"] if found else None

    def num_nodes(self) -> int:
        return self.vertices.count()

    def num_labels(self) -> int:
        return len(self.labels)

    def num_edges(self, label: str) -> int:
        pairs = self.label_edges(label)
        return (pairs if self.unique else pairs.distinct()).count()

    def with_names(self, df: DataFrame, *columns: str) -> DataFrame:
        """`df` with names in place of the ids in `columns`. Of a large dictionary each task hashes a part, so that the many rows of one id, which all meet in a task, are neither sorted nor held."""
        for c in columns:
            if self.named is not None:
                df = df.withColumn(c, self.named(F.col(c)))
            else:
                names = self.vertices.select(F.col("id").alias("__id"), F.col("name").alias("__name"))
                if partitions(names) > FEW_PARTS:
                    names = names.hint("shuffle_hash")
                df = df.join(names, df[c] == names["__id"]).withColumn(c, F.col("__name")).drop("__id", "__name")
        return df

    def check(self) -> PathGraph:
        """The graph itself, if its vertices have ids that come once, and its edges have labels and begin and end at vertices."""
        ids = self.vertices.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
        if ids["n"] != ids["ids"]:
            raise GraphLoadError(f"{ids['n'] - ids['ids']} vertices without an id of their own")
        if self.edges.where("label is null").limit(1).count():
            raise GraphLoadError("an edge has no label")
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select(F.col("dst").alias("id"))).distinct()
        stray = ends.join(self.vertices, ends["id"].eqNullSafe(self.vertices["id"]), "left_anti").take(1)
        if stray:
            raise GraphLoadError(f"an edge has an end that is no vertex: {stray[0]['id']}")
        return self

    @staticmethod
    def from_pairs(pairs: DataFrame, label: str, vertices: DataFrame) -> PathGraph:
        """The graph of one label from its (src, dst) ids and the (id, name) of its vertices."""
        edges = pairs.select("src", F.lit(label).alias("label"), "dst").distinct()
        return PathGraph(edges, vertices.select("id", "name"), known_labels=frozenset([label])).check()

    @staticmethod
    def from_triples(triples: DataFrame, isolated: DataFrame | None = None) -> PathGraph:
        """From (source, label, target) names; `isolated` (name) adds vertices. The triples, the dictionary and the edges are written once, so that input is read once and ids are the same in every task. Tasks get a bounded number of rows each."""
        read = written(triples.select("source", "label", "target").where("source is not null and label is not null and target is not null"), "triples")
        parts = -(-read.count() // TASK_ROWS) or 1
        names = read.select(F.col("source").alias("name")).union(read.select("target"))
        if isolated is not None:
            names = names.union(isolated.select("name"))
        counted = names.repartition(2 * parts, "name").groupBy("name").agg(F.count("*").alias("n"))
        held = written(counted.select(F.monotonically_increasing_id().alias("id"), "name", "n"), "vertices")
        vertices = held.select("id", "name")
        pairs = _numbered(_numbered(read, held, "source", "src", parts), held, "target", "dst", parts)
        edges = written(pairs.select("src", "label", "dst").repartition(parts, "src", "dst").distinct(), "edges", by="label")
        dropped(read)
        return PathGraph(edges, vertices)

    @staticmethod
    def from_edges(spark: SparkSession, edges: Iterable[tuple[str, str, str]]) -> PathGraph:
        """From (source, target, label) tuples."""
        rows = [(s, label, t) for s, t, label in edges]
        return PathGraph.from_triples(spark.createDataFrame(rows, EDGE_SCHEMA))

    @staticmethod
    def from_sources(*sources: DataFrame, isolated: DataFrame | None = None) -> PathGraph:
        """One graph from several sources' (source, label, target), merged by name."""
        whole = sources[0]
        for s in sources[1:]:
            whole = whole.unionByName(s)
        return PathGraph.from_triples(whole, isolated)


def _numbered(rows: DataFrame, names: DataFrame, column: str, out: str, parts: int) -> DataFrame:
    """`rows` with the ids (id, name, n) of the names in a column. The few names that more rows have than a task should get are broadcast, and their rows are spread over all tasks."""
    own = names.select(F.col("id").alias(out), F.col("name").alias("__key")).repartition(parts, "__key")
    often = names.where(F.col("n") > TASK_ROWS).select(F.col("id").alias("__often"), F.col("name").alias(column))
    if not often.take(1):
        return rows.withColumnRenamed(column, "__key").repartition(parts, "__key").join(own, "__key").drop("__key")
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("string"))
    marked = rows.join(F.broadcast(often), column, "left").withColumn("__key", F.when(F.col("__often").isNull(), F.col(column)).otherwise(spread))
    found = marked.repartition(parts, "__key").join(own, "__key", "left").withColumn(out, F.coalesce("__often", out))
    return found.drop("__key", "__often", column)
