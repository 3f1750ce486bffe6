"""Closures: the only iterative code.

Recursive SQL can't express them here, as it has no UNION that drops repeats. A small relation is closed by searches from each source inside tasks, in one job whatever its depth. Of a large one, each connected component of few pairs is closed within a task, all at once; what is left is closed by rounds of joins, each round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Parts, dropped, written
from .components import labelled

#: Pairs of a relation up to which it is broadcast and searched within tasks: 16 bytes each.
LOCAL_PAIRS = 1_000_000
#: Pairs of a component, repeats included, up to which one task closes it.
COMPONENT_PAIRS = 10_000
#: Pairs of whole components that a task closes together, and pairs in a partition of them.
TOGETHER, PARTITION_PAIRS = 20_000, 200_000
#: Places for what the sources of a block may reach, a byte each.
CELLS = 2_000_000


class Adjacency:
    """Successors by vertex, vertices being numbered from 0 in the order of their ids."""

    def __init__(self, s: np.ndarray, t: np.ndarray):
        self.ids, flat = np.unique(np.concatenate([s, t]), return_inverse=True)
        a, b = flat[: len(s)], flat[len(s) :]
        order = np.lexsort((b, a))
        self.to = b[order]
        self.starts = np.searchsorted(a[order], np.arange(len(self.ids) + 1))

    def number(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of those ids that occur."""
        at = np.searchsorted(self.ids, ids)
        at = at[at < len(self.ids)] if len(at) == 0 else np.minimum(at, max(0, len(self.ids) - 1))
        return at[self.ids[at] == ids] if len(self.ids) else np.zeros(0, np.int64)

    def after(self, at: np.ndarray) -> np.ndarray:
        """Successors of vertices, with repeats."""
        sizes = self.starts[at + 1] - self.starts[at]
        if not sizes.sum():
            return np.zeros(0, np.int64)
        return self.to[np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]

    def reached(self, start: int) -> list[int]:
        """What one or more steps lead to."""
        to, starts = self.to, self.starts
        seen: set[int] = set()
        left = [start]
        while left:
            at = left.pop()
            for x in to[starts[at] : starts[at + 1]].tolist():
                if x not in seen:
                    seen.add(x)
                    left.append(x)
        return list(seen)


def _local(pairs: tuple[np.ndarray, np.ndarray], sources: DataFrame) -> DataFrame:
    """(s, t): what each of the sources reaches, found in one job."""
    spark = sources.sparkSession
    shared = spark.sparkContext.broadcast(Adjacency(*pairs))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for batch in batches:
            at, to, held = [], [], 0
            for x in graph.number(batch.column(0).to_numpy()).tolist():
                found = graph.ids[graph.reached(x)]
                at.append(np.full(len(found), graph.ids[x]))
                to.append(found)
                held += len(found)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(np.concatenate(to))], names=["s", "t"])
                    at, to, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(np.concatenate(to))], names=["s", "t"])

    return sources.mapInArrow(search, "s long, t long")


def closed(s: np.ndarray, t: np.ndarray, c: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What the vertices reach at which a pair begins that is marked so, in blocks of (s, t) without repeats. `c` numbers the pairs' components. All sources of a block go a step further at a time; each has a row of as many places as its component has vertices."""
    graph = Adjacency(s, t)
    n = len(graph.ids)
    a, b = np.searchsorted(graph.ids, s), np.searchsorted(graph.ids, t)
    component = np.zeros(n, np.int64)
    component[a] = component[b] = c
    order = np.argsort(component, kind="stable")
    sizes = np.bincount(component)
    place = np.empty(n, np.int64)  # of a vertex, within its component's row
    place[order] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = np.cumsum(sizes) - sizes
    starts = np.unique(a[begins])
    widths = sizes[component[starts]]
    at = 0
    while at < len(starts):
        width = np.cumsum(widths[at : at + CELLS])
        block = starts[at : at + max(1, int(np.searchsorted(width, CELLS, side="right")))]
        width = width[: len(block)]
        at += len(block)
        base = width - sizes[component[block]]
        seen = np.zeros(width[-1], bool)
        row, v = np.arange(len(block)), block
        while len(v):
            degrees = graph.starts[v + 1] - graph.starts[v]
            row, v = np.repeat(row, degrees), graph.after(v)
            cell = base[row] + place[v]
            new = np.flatnonzero(~seen[cell])
            new = new[np.unique(cell[new], return_index=True)[1]]
            seen[cell[new]] = True
            row, v = row[new], v[new]
        cell = np.flatnonzero(seen)
        row = np.searchsorted(width, cell, side="right")
        yield graph.ids[block[row]], graph.ids[order[first[component[block[row]]] + cell - base[row]]]


def _within(pairs: DataFrame, number: int) -> DataFrame:
    """(s, t): the closure of small components (s, t, c), of the pairs' own (s) where `begins`. A component's pairs come to one task one after the other, and only some components are held at a time."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts)
            c = np.unique(rows.column("c").to_numpy(), return_inverse=True)[1]
            for s, t in closed(rows.column("s").to_numpy(), rows.column("t").to_numpy(), c, rows.column("begins").to_numpy()):
                for k in range(0, len(s), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(s[k : k + 200_000]), pa.array(t[k : k + 200_000])], names=["s", "t"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < TOGETHER:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            c = rows.column("c").to_numpy()
            cut = int(np.searchsorted(c, c[-1], side="left"))  # the last component may go on in the next batch
            if cut:
                yield from found(rows.slice(0, cut).to_batches())
                held = rows.slice(cut).to_batches()
        if held:
            yield from found(held)

    spread = pairs.select("s", "t", "c", "begins").repartition(max(1, -(-number // PARTITION_PAIRS)), "c").sortWithinPartitions("c")
    return spread.mapInArrow(search, "s long, t long")


def transitive(pairs: DataFrame, sources: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """The transitive closure of the pairs (s, t), of the given sources (s) only if there are any. It runs jobs at once. The pairs are worked out once and counted; up to `most`, by default LOCAL_PAIRS, they are searched within tasks."""
    held = written(pairs.select("s", "t"), "pairs")
    number, most = held.count(), LOCAL_PAIRS if most is None else most
    if number <= most:
        return _searched(held, sources)
    parts = labelled(held)
    dropped(held)
    if sources is None:
        parts = parts.withColumn("begins", F.lit(True))
    else:
        sources = written(sources.select("s").distinct(), "sources")
        parts = parts.join(sources.withColumn("begins", F.lit(True)), "s", "left").withColumn("begins", F.coalesce("begins", F.lit(False)))
        parts = parts.join(parts.where("begins").select("c").distinct(), "c", "left_semi")
    large = written(parts.groupBy("c").count().where(F.col("count") > COMPONENT_PAIRS).select("c"), "large")
    if not large.take(1):
        dropped(large)
        return _within(parts, number)
    rest = written(parts.join(large, "c", "left_semi").select("s", "t"), "pairs")
    small = _within(parts.join(large, "c", "left_anti"), number)
    if rest.count() <= most:
        return small.union(_searched(rest, sources))
    return small.union(_squared(rest) if sources is None else _stepwise(rest, sources))


def _searched(held: DataFrame, sources: DataFrame | None) -> DataFrame:
    """The closure of few pairs, which are dropped."""
    few = held.toArrow()
    dropped(held)
    s, t = few.column("s").to_numpy(), few.column("t").to_numpy()
    starts = held.sparkSession.createDataFrame(pa.table({"s": np.unique(s)}), "s long") if sources is None else sources.select("s").distinct()
    return _local((s, t), starts)


def _squared(pairs: DataFrame) -> DataFrame:
    """Paths of length 1, then up to 2, 4, 8 ... until nothing is new: few rounds even for long chains. A shortest path of more than the last length begins with one of just that length, so only pairs whose distance it is are joined with all known ones."""
    fresh = written(pairs.distinct().select("s", "t", F.lit(1).cast("long").alias("d")), "closure")
    dropped(pairs)
    known, length = Parts(fresh, "closure"), 1
    while True:
        whole = known.whole()
        ahead = fresh.where(F.col("d") == length).select("s", F.col("t").alias("m"))
        step = ahead.join(whole.select(F.col("s").alias("m"), "t", (F.col("d") + length).alias("d")), "m").groupBy("s", "t").agg(F.min("d").alias("d"))
        fresh = written(step.join(whole, ["s", "t"], "left_anti"), "closure")
        if not fresh.take(1):
            dropped(fresh)
            return known.whole().select("s", "t")
        known.add(fresh)
        length *= 2


def _stepwise(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """Only what is new is joined in each round, and only the sources' pairs are kept."""
    steps = pairs.select(F.col("s").alias("m"), F.col("t").alias("n"))
    fresh = written(sources.select("s").distinct().join(steps, F.col("s") == F.col("m")).select("s", F.col("n").alias("t")).distinct(), "closure")
    known = Parts(fresh, "closure")
    while fresh.take(1):
        step = fresh.join(steps, F.col("t") == F.col("m")).select("s", F.col("n").alias("t")).distinct()
        fresh = written(step.join(known.whole(), ["s", "t"], "left_anti"), "closure")
        known.add(fresh)
    dropped(pairs)
    return known.whole()
