"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Memo, batches, components, dropped, forest, hashable, mix, released, small, table, unused, words, written

LANES = 18  # independent fingerprints of a document
BITS = 32  # of each; wider ones lose pairs near MOST_APART, narrower ones collide by chance, which grows with documents^2 * 2^-BITS
HALF = 1  # half the radius: two fingerprints of a lane collide if they differ in at most 2 * HALF bits
CHECK = 128  # bits, those of f0 and f1, on which colliding pairs are verified
MOST_APART = 20  # of the CHECK bits
PREFIX = 4  # least number of a variant's high bits that choose its place in the shuffle
ROWS = 1 << 21  # fingerprints for which PREFIX bits are enough; twice as many take one bit more
HELD = 100_000  # rows of a task that are expanded at once, and the rest of their last place
KEYS = 1 << 21  # variants of a task that are sorted at once
PAIRED = 512  # rows of one value up to which all their pairs are compared; more are searched from each one reached
CROSSED = 1 << 21  # pairs of two values' rows that are compared; more are searched likewise, so are two values of more than PAIRED rows each
TASK_ROWS = 1 << 20  # rows for which a task is added

WIDE = -(-LANES * BITS // 64)  # words of a document's fingerprints
FULL = [f"f{k}" for k in range(WIDE)]
SEEDS = np.array([0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF for k in range(WIDE)], np.uint64)

_bits = np.empty((2048, 64 * WIDE), np.float32)  # of the tokens of a text, used again by the next: fresh memory for each takes longer than the sums


def fingerprint(tokens: list[str], memo: Memo) -> np.ndarray:
    """LANES * BITS bits in WIDE words: signs of the sums over distinct tokens of their hash bits, each weighing the root of its count."""
    count = Counter(tokens)
    wide = mix(memo.array(count)[:, None] + SEEDS)
    bits = _bits[: len(wide)] if len(wide) <= len(_bits) else np.empty((len(wide), 64 * WIDE), np.float32)
    np.copyto(bits, np.unpackbits(wide.view(np.uint8), axis=1))
    weight = np.sqrt(np.fromiter(count.values(), np.float32, len(count)))
    sign = weight @ bits * 2 > weight.sum()
    sign[LANES * BITS :] = False
    return np.packbits(sign).view(np.uint64)


def lanes(full: np.ndarray) -> np.ndarray:
    """The lanes of n fingerprints (n, WIDE) as (n, LANES) integers of BITS bits."""
    octets = full.view(np.uint8).reshape(len(full), 8 * WIDE)[:, : LANES * BITS // 8].reshape(len(full), LANES, BITS // 8)
    out = np.zeros((len(full), LANES), np.uint64)
    for k in range(BITS // 8):
        out = (out << np.uint64(8)) | octets[:, :, k].astype(np.uint64)
    return out


def ball(values: np.ndarray, bits: int) -> np.ndarray:
    """Each value and its variants with one of the low `bits` bits changed: (n, bits + 1)."""
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(bits, dtype=np.uint64)]).astype(np.uint64)
    return values[:, None] ^ flips[None, :]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, FULL) of every row with a word in its text, h being the hash of the text."""
    memo = Memo()

    def one(batch: pa.RecordBatch) -> dict:
        at, out = [], []
        for k, text in enumerate(batch.column(2).to_pylist()):
            if text and (tokens := words(text)):
                at.append(k)
                out.append(fingerprint(tokens, memo))
        full = (np.array(out, np.uint64) if out else np.zeros((0, WIDE), np.uint64)).view(np.int64)
        return {n: batch.column(k).take(pa.array(at, pa.int32())) for k, n in enumerate(("doc_id", "h"))} | {n: full[:, k] for k, n in enumerate(FULL)}

    return batches(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), one, "doc_id long, h long, " + ", ".join(f"{n} long" for n in FULL))


def prefix_bits(fingerprints: int) -> int:
    """High bits that choose a place: places grow in number with the table, so none grows large."""
    return min(BITS - 8, PREFIX + max(0, math.ceil(math.log2(max(1, fingerprints) / ROWS))))


def places(prints: DataFrame, prefix: int) -> DataFrame:
    """Where the variants of each fingerprint go: rows (place, low, node, f0, f1).

    The variants of a lane that share their `prefix` high bits go to one place, so they travel as one row and are spelt out there: one row for the own prefix, whose `low` bits are marked by a high bit of their own, and one for each neighbour.
    """
    rest = BITS - prefix

    def one(batch: pa.RecordBatch) -> dict:
        full = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in FULL], axis=1).view(np.uint64)
        lane = lanes(np.ascontiguousarray(full)).reshape(-1)
        n, each = len(full), LANES * (prefix + 1)
        place = ball(lane >> np.uint64(rest), prefix).reshape(n, LANES, prefix + 1)
        place |= np.arange(LANES, dtype=np.uint64)[None, :, None] << np.uint64(prefix)
        low = np.repeat((lane & np.uint64((1 << rest) - 1))[:, None], prefix + 1, axis=1)
        low[:, 0] |= np.uint64(1 << rest)
        node = batch.column("node").to_numpy(zero_copy_only=False)
        return {"place": place.reshape(-1).view(np.int64), "low": low.reshape(-1).view(np.int64), "node": np.repeat(node, each), "f0": np.repeat(full[:, 0].view(np.int64), each), "f1": np.repeat(full[:, 1].view(np.int64), each)}

    return batches(prints, one, "place long, low long, node long, f0 long, f1 long")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def linked(node: np.ndarray, full: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at most MOST_APART bits apart among distinct nodes.

    Each node reached is compared with all those not reached yet, so a dense group takes about one comparison a node and no pair within reach is missed.
    """
    left, out = np.arange(len(node)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = apart(full[left], full[at]) <= MOST_APART
            found = left[near]
            left = left[~near]
            queue.extend(found)
            out += [(int(node[at]), int(node[x])) for x in found]
    return out


def met(rows_in: pa.Table, rest: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join what the verified pairs among the fingerprints of whole places join: each node with the least one that it is joined to.

    Rows of one value and kind, whose variants are the same, are a cell: they are compared with each other once, not at each variant. Variants are spelt out by cell and sorted as numbers that end in the cells, slice by slice of the places so that about KEYS are held at once. Two cells that share variants are compared at one of them, all such cells together, as pairs that meet by chance grow with the square of the table; large cells are linked by themselves.
    """
    column = lambda n: rows_in.column(n).to_numpy()
    base, low = column("place").view(np.uint64) << np.uint64(rest), column("low").view(np.uint64)
    code = (base | (low & np.uint64((1 << rest) - 1))) << np.uint64(1) | ((low >> np.uint64(rest)) > 0)
    order = np.argsort(code)
    code, node = code[order], column("node")[order]
    full = np.stack([column(n)[order] for n in FULL[: CHECK // 64]]).view(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    size = np.diff(np.append(first, len(code)))
    value, own = code[first] >> np.uint64(1), (code[first] & np.uint64(1)) > 0
    links: list[tuple[np.ndarray, np.ndarray]] = []

    def add(a: np.ndarray, b: np.ndarray) -> None:
        links.append((a, b))
        if sum(len(x) for x, _ in links) > KEYS:
            links[:] = [spanned(links)]

    def compared(a: np.ndarray, b: np.ndarray) -> None:
        good = np.flatnonzero(np.bitwise_count(full[0][a] ^ full[0][b]) <= MOST_APART)
        a, b = a[good], b[good]
        good = apart(full[:, a].T, full[:, b].T) <= MOST_APART
        if good.any():
            add(node[a[good]], node[b[good]])

    def searched(*cells: int) -> None:
        group = np.concatenate([np.arange(first[c], first[c] + size[c]) for c in cells])
        if edges := linked(node[group], full[:, group].T):
            add(*np.array(edges, np.int64).T)

    def crossed(a: np.ndarray, b: np.ndarray) -> None:
        """All rows of each cell of a with those of its cell of b."""
        pairs = size[a] * size[b]
        many = ((size[a] > PAIRED) & (size[b] > PAIRED)) | (pairs > CROSSED)
        for x, y in zip(a[many], b[many], strict=True):
            searched(x, y)
        one = pairs == 1
        compared(first[a[one]], first[b[one]])
        some = ~one & ~many
        a, b, pairs = a[some], b[some], pairs[some]
        until = np.cumsum(pairs)
        for part in np.split(np.arange(len(a)), np.searchsorted(until, np.arange(KEYS, until[-1], KEYS)) if len(a) else []):
            n = pairs[part]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            each = np.repeat(size[b[part]], n)
            compared(np.repeat(first[a[part]], n) + k // each, np.repeat(first[b[part]], n) + k % each)

    for c in np.flatnonzero(size > PAIRED):
        searched(c)
    end, offset = np.repeat(first + size, size), 1
    pos = np.flatnonzero(np.repeat(size <= PAIRED, size))
    while len(pos := pos[pos + offset < end[pos]]):
        compared(pos, pos + offset)
        offset += 1

    count = np.uint64(max(1, len(first).bit_length()))
    assert BITS + LANES.bit_length() + int(count) <= 64
    k = min(rest, max(0, math.ceil(math.log2(max(1, own.sum() * (rest + 1) + len(first)) / KEYS))))
    inner = rest - k  # low bits of a variant that are spelt out in its slice
    top = (value & np.uint64((1 << rest) - 1)) >> np.uint64(inner)
    bottom = value ^ (top << np.uint64(inner))
    for s in range(1 << k):
        away = np.bitwise_count(top ^ np.uint64(s))
        here, single = np.flatnonzero(own & (away == 0)), np.flatnonzero(np.where(own, away == 1, away == 0))
        at = np.uint64(s << inner)
        key = np.concatenate([(((ball(bottom[here], inner) | at) << count) | here.astype(np.uint64)[:, None]).reshape(-1), ((bottom[single] | at) << count) | single.astype(np.uint64)])
        key.sort()
        cell = (key & np.uint64((1 << int(count)) - 1)).astype(np.int32)
        key >>= count
        pos, offset = np.flatnonzero(key[1:] == key[:-1]), 1
        while len(pos):
            a, b = cell[pos], cell[pos + offset]
            differ = value[a] ^ value[b]
            once = ~(own[a] & own[b]) | (key[pos] == value[a] ^ (differ & (~differ + np.uint64(1))))  # two whole balls share two variants: the one that has the lowest of the bits changed counts
            crossed(a[once], b[once])
            offset += 1
            pos = pos[pos + offset < len(key)]
            pos = pos[key[pos] == key[pos + offset]]
    return spanned(links)


def spanned(links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Fewest links that join what the given ones join."""
    nodes, roots = forest(np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])) if links else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return roots[nodes != roots], nodes[nodes != roots]


def meetings(rows: DataFrame, prefix: int, partitions: int) -> DataFrame:
    """Links (a, b) that join the fingerprints that verified pairs join, of those that share a variant. A task works through its places in order, about HELD rows at a time."""
    rest = BITS - prefix

    def run(source):
        held: list[pa.RecordBatch] = []

        def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b = met(pa.Table.from_batches(parts), rest)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in source:
            if not batch.num_rows:
                continue
            place = batch.column(0).to_numpy()
            if sum(b.num_rows for b in held) >= HELD and place[-1] != held[0].column(0)[0].as_py():
                cut = int(np.searchsorted(place, place[-1], side="left"))  # the last place may go on in the next batch
                if cut:
                    yield links([*held, batch.slice(0, cut)])
                    held = [batch.slice(cut)]
                    continue
                last = held[-1].column(0).to_numpy()
                if last[-1] != place[0]:
                    yield links(held)
                    held = []
            held.append(batch)
        if held:
            yield links(held)
        released()

    return rows.repartition(partitions, "place").sortWithinPartitions("place").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, h, root) of every row with a word in its text: the hash of the text, and the number of its group of near-duplicates."""
    prints = written(fingerprints(docs), "prints")
    nodes = written(prints.select(*FULL).distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    number = nodes.count()
    prefix = prefix_bits(number)
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(number * LANES * (prefix + 1) / TASK_ROWS))
    links = written(meetings(places(nodes, prefix), prefix, partitions).distinct(), "links")
    roots = components(links)
    out = written(prints.join(nodes, FULL).join(roots, "node", "left").select("doc_id", "h", F.coalesce("root", "node").alias("root")), "groups")
    dropped(prints, nodes, links, roots)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of) for every document that is not the least doc_id of its group of near-duplicates.

    A document's SimHash over its lower-case words is LANES fingerprints of BITS bits. Each emits all variants within HALF a radius; documents that share a variant, so differ in at most 2 * HALF bits of a lane, are compared on CHECK bits and linked if at most MOST_APART of them differ. Groups are the connected components of the links, so copies of any number form one group. Equal fingerprints are joined first and emit once.

    Texts that are null, empty or have no word are in no group, nor are rows whose doc_id is null; an empty table has no group. Repeated rows are one document. A doc_id that comes with several texts is one document that belongs to the groups of all of them, which it joins. Ties: the least doc_id stands for its group. Very long texts are processed whole. Other columns, of any name, are ignored.
    """
    rows = grouped(docs.where("doc_id is not null"))
    least = rows.groupBy("root").agg(F.min("doc_id").alias("least"))
    of = written(rows.select("doc_id", "root").distinct().join(least, "root").select("doc_id", "least"), "of")
    dropped(rows)
    several = of.groupBy("doc_id").agg(F.min("least").alias("b"), F.max("least").alias("c")).where("b <> c")
    if several.limit(1).count():  # rare: a repeated doc_id joins groups
        joined = components(of.join(several, "doc_id").select(F.col("least").alias("a"), "b"))
        of = of.join(joined, of["least"] == joined["node"], "left").select("doc_id", F.coalesce("root", "least").alias("least"))
    return of.where("doc_id <> least").select("doc_id", F.col("least").alias("duplicate_of")).distinct()


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts, with all its columns.

    Decisions are made by row, from its text, whatever the doc_ids: of a group stays the row with the least doc_id (a null one comes last), then the least text hash; of rows equal in both the one with the least hash of all columns, so a repeated row stays once. Rows whose text is null, empty or without a word are in no group and all stay. A doc_id with several texts keeps those that have no earlier near-duplicate. An empty table stays empty; other columns may have any name.
    """
    rows = grouped(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    best = rows.groupBy("root").agg(F.min(order).alias("best")).withColumnRenamed("root", "of")
    kinds = rows.groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))
    first = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.h") == F.col("h"))
    told = kinds.join(best, F.col("root") == F.col("of")).select(F.col("doc_id").alias("told_doc"), F.col("h").alias("told_h"), first.alias("first"), "n").where("not first or n > 1")
    told = written(told, "told")
    dropped(rows)
    def same(other: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(other["told_doc"]) & (F.xxhash64(docs["text"]) == other["told_h"])

    again, told = small(told.where("first")), small(told)
    kept = docs.join(told, same(told), "left_anti")
    if again.limit(1).count():  # rows of one doc_id and text
        mark = unused(docs, "row")
        by = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*hashable(docs)))
        kept = kept.union(docs.join(again, same(again), "left_semi").withColumn(mark, F.row_number().over(by)).where(F.col(mark) == 1).drop(mark))
    return kept
