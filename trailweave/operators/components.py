"""Weakly connected components of a relation, by forests of its chunks and then of what these have in common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written

#: Pairs that a task joins at once, whatever its partition has.
CHUNK = 500_000
#: Links between chunks up to which the driver joins them: 16 bytes each.
DRIVER_LINKS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the links (a, b), in order, and the least of each one's component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    up = np.arange(len(nodes))
    while True:
        top = up[up]
        new = np.minimum(up, top)
        for x, low in ((up[i], top[j]), (up[j], top[i]), (i, top[j]), (j, top[i])):
            np.minimum.at(new, x, low)
        if (new == up).all():
            return nodes, nodes[up]
        up = new


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches in tables of about `most` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _rooted(pairs: DataFrame) -> DataFrame:
    """(s, t, r): r is the least vertex that the pair's chunk joins to it."""
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, chunk):
            s, t = rows.column("s").to_numpy(), rows.column("t").to_numpy()
            nodes, roots = forest(s, t)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(t), pa.array(roots[np.searchsorted(nodes, s)])], names=["s", "t", "r"])

    return pairs.select("s", "t").mapInArrow(run, "s long, t long, r long")


def labelled(pairs: DataFrame) -> DataFrame:
    """(s, t, c): the pairs (s, t), repeats included, with a vertex that stands for their component. It runs jobs at once; the result is a table in the shared folder."""
    rooted = written(_rooted(pairs), "rooted")
    spots = rooted.select(F.col("s").alias("v"), "r").union(rooted.select("t", "r"))
    shared = spots.groupBy("v").agg(F.min("r").alias("m"), F.max("r").alias("x")).where("m < x").select("v", "m")
    links = written(spots.join(shared, "v").where("r > m").select(F.col("r").alias("a"), F.col("m").alias("b")).distinct(), "links")
    n = links.count()
    if not n:
        dropped(links)
        return rooted.withColumnRenamed("r", "c")
    roots = _joined(links, n)
    out = written(rooted.join(roots, F.col("r") == F.col("node"), "left").select("s", "t", F.coalesce("root", "r").alias("c")), "components")
    dropped(rooted)
    return out


def _joined(links: DataFrame, n: int) -> DataFrame:
    """(node, root) of the components of links (a, b), which are dropped: on the driver if they are few, else by alternating large-star and small-star rounds."""
    if n <= DRIVER_LINKS:
        small = links.toArrow()
        dropped(links)
        nodes, roots = forest(small.column("a").to_numpy(), small.column("b").to_numpy())
        return F.broadcast(links.sparkSession.createDataFrame(pa.table({"node": nodes, "root": roots}), "node long, root long"))
    state, now = None, links
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        after = written(large.join(lower, "a").select(ends.alias("e")).select("e.a", "e.b").where("a <> b").distinct(), "links")
        row = after.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        dropped(now)
        now = after
        if state == (row["n"], row["x"]):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = row["n"], row["x"]
