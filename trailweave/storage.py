"""Tables that outlive the tasks that made them, for plans that would otherwise grow with each round."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, as in tests, a temporary one, but never on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _own_dir
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="trailweave-")
    return _own_dir


def written(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """`df` as a table in the shared folder: its lineage ends there, and a lost executor loses nothing of it. If it is partitioned by a column, a filter on that reads its part only."""
    path = os.path.join(shared_dir(df.sparkSession), f"{what}-{uuid.uuid4().hex}")
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    out._trailweave_path = path
    if _scratch:
        _scratch[-1].append(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written in this context are deleted at its end, but for those whose paths are taken from the list."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def path_of(df: DataFrame) -> str:
    """The folder of a table made by `written`."""
    return df._trailweave_path


#: Bytes of the files that rows come from for each partition of them, partitions up to which their number is left to Spark, and the most.
PART_BYTES, FEW_PARTS, MOST_PARTS = 2_000_000, 16, 2_000


def read_bytes(*frames: DataFrame) -> int:
    """Bytes of the files and other leaves that DataFrames come from, each as often as it is read; what is unknown counts for nothing."""
    total = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
        total += sum(n for n in sizes if n < 1 << 60)
    return total


def partitions(*frames: DataFrame) -> int:
    """In how many parts to deal out rows that come from these: a number that grows with what is read, so that a task's rows don't."""
    return min(max(1, read_bytes(*frames) // PART_BYTES), MOST_PARTS)


class Parts:
    """A relation that grows by rounds: each round's rows are written once, and the parts are joined into one table when there are many."""

    MOST = 16  # parts to read in each round

    def __init__(self, first: DataFrame, what: str):
        self.parts, self.what = [first], what

    def add(self, df: DataFrame) -> None:
        self.parts.append(df)
        if len(self.parts) >= self.MOST:
            kept = written(self.whole(), self.what)
            for p in self.parts[:-1]:  # the last one is the next round's input
                dropped(p)
            self.parts = [kept]

    def whole(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.union(p)
        return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by `written`."""
    if path := getattr(df, "_trailweave_path", None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
