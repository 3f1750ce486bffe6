"""Near-duplicates of embeddings: spherical k-means cells and blocked cosine products within them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, dropped, forest, table, written

COSINE = 0.9  # least cosine of a near-duplicate
ROUNDS = 4  # of k-means
SCALE = 1 << 20  # of the whole numbers in which centroids are summed, so that no order changes them
VISITS = 4  # nearest cells of a vector in which it is compared, whatever the number of cells
BLOCK = 16384  # vectors in a side of a block of cosine products
PAIRS = 2_000_000  # of a block that are held before they are reduced to a forest


def matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type = np.float32) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def by_width(column: pa.Array, kind: type = np.float32) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of vectors of several widths: each width, the places of its vectors, and they as a matrix."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for width in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == width)
        yield width, at, matrix(column if len(at) == len(sizes) else column.take(pa.array(at)), width, kind)


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of every row with an id and a direction."""

    def run(source):
        for batch in cut(source):
            for width, at, x in by_width(batch.column(1), np.float64):
                with np.errstate(all="ignore"):
                    square = (x * x).sum(axis=1)
                good = np.flatnonzero((square > 0) & (square < np.inf))
                unit = (x[good] / np.sqrt(square[good])[:, None]).astype(np.float32) + np.float32(0)  # no negative zero
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1, dtype=np.int32) * width), pa.array(unit.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[good])), values], names=["vec_id", "x"])

    usable = embeddings.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, x array<float>")


class Cells:
    """Unit centroids by width of their vectors; cells of all widths are numbered together."""

    def __init__(self, of: dict[int, np.ndarray]):
        self.of, self.base, n = of, {}, 0
        for width in sorted(of):
            self.base[width] = n
            n += len(of[width])

    def set(self, cell: int, total: np.ndarray) -> None:
        if (length := np.linalg.norm(total)) > 0:
            self.of[len(total)][cell - self.base[len(total)]] = total / length


def centroids(vectors: DataFrame) -> Cells:
    """Unit centroids by spherical k-means over all vectors of each width, as many as the root of their number, from those of the least hashed nodes."""
    spark = vectors.sparkSession
    counts = {r["width"]: r["n"] for r in vectors.groupBy("width").agg(F.count("*").alias("n")).collect()}
    number = {w: math.ceil(math.sqrt(n)) for w, n in counts.items()}
    if not counts:
        return Cells({})
    steps = F.create_map(*[F.lit(v) for w, n in counts.items() for v in (w, max(1, n // (2 * number[w] + 64)))])
    h = F.xxhash64("node")
    first = vectors.where(F.pmod(h, steps[F.col("width")]) == 0).select("width", "x", h.alias("h"), "node").collect()
    first.sort(key=lambda r: (r["h"], r["node"]))
    cells = Cells({w: np.array([r["x"] for r in first if r["width"] == w][: number[w]], np.float32) for w in counts})
    shape = "cell int, total binary"
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(cells)

        def assign(source, shared=shared):
            cells = shared.value
            sums: dict[int, np.ndarray] = {}
            for batch in source:
                for width, _, x in by_width(batch.column(0)):
                    c = cells.of[width]
                    total = sums.setdefault(width, np.zeros((len(c), width), np.int64))
                    best = np.concatenate([(x[s : s + 4096] @ c.T).argmax(axis=1) for s in range(0, len(x), 4096)])
                    order = np.argsort(best, kind="stable")
                    starts = np.flatnonzero(np.concatenate([[True], best[order][1:] != best[order][:-1]]))
                    total[best[order][starts]] += np.add.reduceat(np.rint(x[order] * SCALE).astype(np.int64), starts, axis=0)
            rows = [(cells.base[w] + j, t[j].tobytes()) for w, t in sums.items() for j in np.flatnonzero(t.any(axis=1)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["cell", "total"])

        def add(source):
            out: dict[int, np.ndarray] = {}
            for batch in source:
                for j, total in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                    out[j] = out.get(j, 0) + np.frombuffer(total, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([v.tobytes() for v in out.values()], pa.binary())], names=["cell", "total"])

        for r in vectors.select("x").mapInArrow(assign, shape).repartition("cell").mapInArrow(add, shape).toLocalIterator():
            cells.set(r["cell"], np.frombuffer(r["total"], np.int64).astype(np.float64))
        shared.unpersist()
    return cells


def nearest(x: np.ndarray, cells: Cells, width: int) -> Iterator[np.ndarray]:
    """(vectors, VISITS) numbers of the cells whose centroids are nearest, 4,096 vectors at a time."""
    c = cells.of[width]
    visits = min(VISITS, len(c))
    for s in range(0, len(x), 4096):
        yield np.argpartition(-(x[s : s + 4096] @ c.T), visits - 1, axis=1)[:, :visits] + cells.base[width]


def placed(vectors: DataFrame, cells: Cells) -> DataFrame:
    """(cell, node, x): each vector in the VISITS cells whose centroids are nearest. What is copied is a fixed number of times the input, however many cells there are."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def place(source):
        cells = shared.value
        for batch in source:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            for width, at, x in by_width(batch.column(1)):
                for k, near in enumerate(nearest(x, cells, width)):
                    own = slice(4096 * k, 4096 * k + len(near))
                    values = pa.ListArray.from_arrays(pa.array(np.arange(near.size + 1, dtype=np.int32) * width), pa.array(np.repeat(x[own], near.shape[1], axis=0).reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1), pa.int32()), pa.array(np.repeat(node[at[own]], near.shape[1]), pa.int64()), values], names=["cell", "node", "x"])

    return vectors.select("node", "x").mapInArrow(place, "cell int, node long, x array<float>")


def cell_sizes(vectors: DataFrame, cells: Cells) -> DataFrame:
    """(of, blocks): the blocks of each cell. The cells are worked out again rather than written, as the copies are several times the input."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def count(source):
        cells = shared.value
        total = np.zeros(sum(map(len, cells.of.values())), np.int64)
        for batch in source:
            for width, _, x in by_width(batch.column(0)):
                for near in nearest(x, cells, width):
                    total += np.bincount(near.reshape(-1), minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["of", "n"])

    counts = vectors.select("x").mapInArrow(count, "of int, n long")
    return counts.groupBy("of").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("blocks"))


def links(rows: DataFrame, sizes: DataFrame, cosine: float) -> DataFrame:
    """Links (a, b) of vectors at least `cosine` alike that share a cell: its vectors are compared in pairs of blocks, each of which gives a spanning forest of its pairs."""
    blocked = rows.join(sizes, F.col("cell") == F.col("of")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.select("cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "x")

    def compare(block: pa.Table) -> pa.Table:
        mine, i, j = block.column("mine").to_numpy(), block.column("i")[0].as_py(), block.column("j")[0].as_py()
        node, x = block.column("node").to_numpy(), matrix(block.column("x"), len(block.column("x")[0]))
        a_nodes, a, b_nodes, b = node[mine == i], x[mine == i], node[mine == j], x[mine == j]
        p, q, held = [], [], 0
        for s in range(0, len(a), 256):
            after = s if i == j else 0  # the earlier ones have been compared
            u, v = np.nonzero(a[s : s + 256] @ b[after:].T >= np.float32(cosine))
            u, v = a_nodes[s : s + 256][u], b_nodes[after:][v]
            p.append(u[u != v])
            q.append(v[u != v])
            held += len(p[-1])
            if held > PAIRS:
                p, q = ([f] for f in forest(np.concatenate(p), np.concatenate(q)))
                held = 0
        p, q = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (p, q))
        if len(p):
            p, q = forest(p, q)
            p, q = p[p != q], q[p != q]
        return pa.table({"a": pa.array(p, pa.int64()), "b": pa.array(q, pa.int64())})

    return pairs.groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, group_id, keep) for every vec_id: the least vec_id of its group of near-duplicates, and whether it is that one, which is kept.

    Spherical k-means with as many cells as the root of the number of vectors, for each width of vectors, puts each vector in its VISITS nearest cells. All vectors of a cell are compared in blocks of about BLOCK a side; those of at least `cosine` are linked and groups are the connected components. Equal directions are joined beforehand and compared once. A pair is missed only if none of its nearest cells is the same; tests measure the recall against brute force.

    Null and empty embeddings and those with a zero, infinite or undefined length are kept in groups of their own; vectors are only like those of their own width. Null vec_ids are left out; a repeated vec_id is one node and gives one row, in the group of all its vectors. Ties: the least vec_id stands for its group. An empty table gives an empty one; other columns, of any name, are ignored.
    """
    unit = unit_vectors(embeddings)
    key = [F.xxhash64("x").alias("g"), F.hash("x").alias("g2")]
    ids = embeddings.where("vec_id is not null").select("vec_id").distinct()
    vectors = written(unit.groupBy("x").agg(F.min("vec_id").alias("node")).select("node", F.size("x").alias("width"), "x"), "vectors")
    same = unit.select("vec_id", *key).join(vectors.select("node", *key), ["g", "g2"]).where("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    cells = centroids(vectors)
    roots = components(links(placed(vectors, cells), cell_sizes(vectors, cells), cosine).union(same))
    dropped(vectors)
    root = F.coalesce("root", "vec_id")
    return ids.join(roots, ids["vec_id"] == roots["node"], "left").select("vec_id", root.alias("group_id"), (F.col("vec_id") == root).alias("keep"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE LIST_COSINE_SIMILARITY(a.embedding, b.embedding) >= {COSINE}),
reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT vec_id, MIN(other) AS group_id, vec_id = MIN(other) AS keep FROM reach GROUP BY vec_id
"""
