"""Graphs from a directory of MatrixMarket files: vertices.txt and edges.txt map names to numbers from 1, and <n>.txt is the adjacency matrix of label n."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormatError, InvalidFormat
from ..functions.names import bare_name, with_base
from ..graph import PathGraph
from ..storage import written

SHAPE = r"^(.*)\s(\S+)$"


def _why(line: str) -> str | None:
    parts = line.strip().rsplit(None, 1)
    if len(parts) < 2:
        return "expected a name and an index, but there is no white space"
    if not (parts[1].isascii() and parts[1].lstrip("+").isdigit()):
        return f"index '{parts[1]}' is not a positive integer"
    if int(parts[1]) == 0:
        return "an index must be 1 or more"
    return None


def _first_fault(path: str, spark: SparkSession, duplicates: set[int]) -> InvalidFormat:
    """Read again, in order, only to say where the fault is."""
    seen: set[int] = set()
    for n, row in enumerate(spark.read.text(path).toLocalIterator(), 1):
        line = row["value"]
        if not line.strip():
            continue
        why = _why(line)
        if why is None:
            index = int(line.split()[-1])
            if index in seen:
                why = f"duplicate index {index}"
            seen.add(index)
        if why is not None:
            return InvalidFormat(os.path.basename(path), n, why)
    return InvalidFormat(os.path.basename(path), None, f"duplicate index {min(duplicates, default=0)}")


def index_map(spark: SparkSession, path: str) -> DataFrame:
    """(index, name, at) of a map file, `at` growing from line to line. The name is what stands before the last white space, without its angle brackets. An index must be a whole number from 1 and come once; names may repeat."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("line"), F.monotonically_increasing_id().alias("at")).where("line <> ''")
    parts = lines.select("at", F.regexp_extract("line", SHAPE, 1).alias("raw"), F.regexp_extract("line", SHAPE, 2).alias("digits"))
    rows = parts.select("at", "raw", F.when(F.col("digits").rlike(r"^\+?[0-9]{1,18}$"), F.regexp_replace("digits", r"^\+", "").cast("long")).alias("index"))
    fault = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("index") > 0, 1)).alias("good"), F.count_distinct("index").alias("distinct")).first()
    if fault["n"] != fault["good"] or fault["n"] != fault["distinct"]:
        twice = {r["index"] for r in rows.groupBy("index").count().where("count > 1").limit(1).collect()}
        raise _first_fault(path, spark, {x for x in twice if x is not None})
    return rows.select("index", bare_name(F.col("raw")).alias("name"), "at")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) from 0 of a coordinate file, or of a folder of files of which the first by name begins with the header and the size line. Values don't matter, explicit zeros count; symmetric files have each entry both ways."""
    every = spark.read.text(path)
    names = sorted(every.inputFiles(), key=os.path.basename)
    lines = (spark.read.text(names[0]) if len(names) > 1 else every).withColumn("at", F.monotonically_increasing_id())
    file = os.path.basename(path)
    top = lines.orderBy("at").limit(1).collect()
    if not top or not top[0]["value"].lower().startswith("%%matrixmarket"):
        raise InvalidFormat(file, 1, "expected a MatrixMarket header")
    kinds = top[0]["value"].lower().split()
    if len(kinds) < 5 or kinds[1] != "matrix" or kinds[2] != "coordinate":
        raise InvalidFormat(file, 1, "only coordinate matrices are supported")
    says = ~F.col("value").startswith("%") & (F.trim("value") != "")
    said = lines.where(says)
    sizes = said.orderBy("at").limit(1).collect()
    shape = sizes[0]["value"].split() if sizes else []
    if len(shape) != 3 or not all(x.isdigit() for x in shape):
        raise InvalidFormat(file, sizes[0]["at"] + 1 if sizes else None, "expected a size line")
    cells = F.split(F.trim("value"), r"\s+")
    entries = said.where(F.col("at") > sizes[0]["at"])
    if len(names) > 1:
        entries = entries.select("value").union(spark.read.text(names[1:]).where(says))
    entries = entries.select(F.get(cells, F.lit(0)).try_cast("long").alias("row"), F.get(cells, F.lit(1)).try_cast("long").alias("column"))
    rows, columns, number = map(int, shape)
    good = F.col("row").between(1, rows) & F.col("column").between(1, columns)
    found = entries.agg(F.count("*").alias("n"), F.count(F.when(good, 1)).alias("good")).first()
    if found["n"] != found["good"]:
        raise InvalidFormat(file, None, f"{found['n'] - found['good']} entries aren't within {rows} rows and {columns} columns")
    if found["n"] != number:
        raise InvalidFormat(file, None, f"{found['n']} entries, but the size line says {number}")
    out = entries.select((F.col("row") - 1).alias("src"), (F.col("column") - 1).alias("dst"))
    if kinds[4] in ("symmetric", "skew-symmetric", "hermitian"):
        out = out.union(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return out


def read_matrix_market(spark: SparkSession, directory: str, base: str | None = None) -> PathGraph:
    """The graph of a directory. Vertices are all those of vertices.txt, with an edge or without; ids are their indices less 1. `base` goes before the names of vertices and labels. Of vertices with the same name, that of the last line stands for it in queries."""
    vertices = index_map(spark, os.path.join(directory, "vertices.txt")).select((F.col("index") - 1).alias("id"), with_base(F.col("name"), base).alias("name"), "at")
    names = written(vertices, "vertices")
    edges: DataFrame | None = None
    labels = index_map(spark, os.path.join(directory, "edges.txt")).orderBy("index").collect()
    for r in labels:
        path = os.path.join(directory, f"{r['index']}.txt")
        try:
            part = matrix(spark, path)
        except FormatError:
            raise
        except Exception as e:
            raise FormatError(f"can't read {path}: {e}") from e
        part = part.select("src", F.lit((base or "") + r["name"]).alias("label"), "dst")
        edges = part if edges is None else edges.union(part)
    if edges is None:
        edges = spark.createDataFrame([], "src long, label string, dst long")
    return PathGraph(written(edges.distinct(), "edges", by="label"), names, known_labels=frozenset((base or "") + r["name"] for r in labels)).check()


def triples(graph: PathGraph) -> DataFrame:
    """(source, label, target) of a graph, to be merged with other sources by name."""
    rows = graph.edges.select(F.col("src").alias("source"), "label", F.col("dst").alias("target"))
    return graph.with_names(rows, "source", "target")
