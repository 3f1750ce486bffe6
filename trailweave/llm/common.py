"""Helpers that the training-data operators share: tables, durable cuts, tokens, hashes."""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written  # noqa: F401

WORD = re.compile(r"\w+")
EDGE = re.compile(r"^\W+|\W+$")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dropped(*frames: DataFrame) -> None:
    """Deletes tables made by `written` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for file in {os.path.dirname(f) for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BROADCAST_ROWS = 1_000_000  # narrow rows of decisions that are broadcast, so that the texts they are about stay where they are; with more both sides are shuffled


def small(df: DataFrame) -> DataFrame:
    """A table of decisions of a few numbers each, to be joined with texts: broadcast if its rows, which are counted, are no more than BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the rows don't have yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def hashable(df: DataFrame) -> list[str]:
    """The columns that Spark can hash: all but those with maps."""
    return [f"`{c.name}`" for c in df.schema if "map<" not in c.dataType.simpleString()]


def words(text: str) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return WORD.findall(text.lower())


class Memo(dict):
    """Word to unsigned 64-bit hash; emptied when it holds `most` words, which changes no result."""

    def __init__(self, seed: int = 0, most: int = 200_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def array(self, items) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, items), np.uint64, len(items))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def portions(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that have about `most` characters together, so that a batch's words aren't all held at once."""
    start = held = 0
    for k, text in enumerate(texts):
        held += len(text) if text else 0
        if held >= most:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


BATCH_BYTES = 4 << 20  # of a record batch that are worked on at once


kept: dict[str, tuple] = {}  # what a worker keeps for the next task of the same operator


def cut(source: Iterator[pa.RecordBatch], keep: str = "", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The record batches in slices of about `most` bytes, so that what is made of a batch of long texts isn't all held at once; at their end, free memory goes back to the system, as workers outlive their tasks. Of what the worker has kept, only what is kept under the given name stays."""
    for name in [n for n in kept if n != keep]:
        del kept[name]
    try:
        for batch in source:
            step = max(1, batch.num_rows * most // max(most, batch.nbytes))
            for s in range(0, batch.num_rows, step):
                yield batch.slice(s, step)
    finally:
        released()


def released() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def batches(df: DataFrame, function, schema: str, keep: str = "") -> DataFrame:
    """mapInArrow with a function from a record batch to a dict of columns (or None for no rows)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(source, keep):
            out = function(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the links (a, b), each node with the least node of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return nodes, nodes[label]


LOCAL_LINKS = 1_000_000  # that one task joins; more are joined in rounds, with the same result


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b): one row (node, root) for every node of an edge, root being the least node reached.

    Up to LOCAL_LINKS distinct edges are joined by one task. More take alternating large-star and small-star rounds; each round's edges are written to the shared folder. Self-loops, repeats and nulls in the input count for nothing.
    """
    now = written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    if now.count() <= LOCAL_LINKS:

        def join(source):
            parts = [b for b in source if b.num_rows]
            rows = pa.Table.from_batches(parts) if parts else None
            nodes, roots = forest(rows.column("a").to_numpy(), rows.column("b").to_numpy()) if parts else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "root"])

        out = written(now.coalesce(1).mapInArrow(join, "node long, root long"), "roots")
        dropped(now)
        return out
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after = written(small, "edges")
        row = after.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        dropped(now)
        now = after
        if state == (row.n, row.x):
            break
        state = (row.n, row.x)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
