"""Repeated passages by a depth-limited radix sort of suffixes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Memo, cut, mix, table, words

DEPTH = 50  # words through which suffixes are ordered
DIGIT = 8  # words of the run by which suffixes are distributed
RADIX = 10  # words of a digit of the passes
CHUNK = 1 << 19  # words that are worked on at once
PLACE_BITS = 26
HOT = 20_000  # rows of a place from which they are sorted as they come, beside its distinct windows only
PRIMER = 100_000  # bytes of some texts with which rows are compressed on their way, which changes no result

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def rolling(tokens: np.ndarray, width: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A hash of the `width` tokens from each place on, from differences of one running sum."""
    n = len(tokens)
    with np.errstate(over="ignore"):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * up[:n], dtype=np.uint64)])
        return mix((running[width:] - running[: n - width + 1]) * down[: n - width + 1])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values from each place on."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)[: n - width + 1]
    behind = np.minimum.accumulate(padded, axis=1).reshape(-1)[width - 1 : n]
    return np.minimum(ahead, behind)


def first_pass(ids: list, texts: list[list[str]], coded: list[np.ndarray], depth: int, packer: zstandard.ZstdCompressor) -> Iterator[pa.RecordBatch]:
    """The suffixes of the texts by the place where they are sorted: rows (place, doc_id, start, windows, words).

    The place of a suffix is that of the least run of DIGIT words among its first `depth` words, in the order of the runs' hashes and then of their positions, so suffixes that are equal through `depth` words have equal places. Successive suffixes of one run make one row, with the words that they need between them.

    Suffixes that are equal to others of these texts are known to be repeated: their stretches go as rows without words, to any place, and one of each kind stands for them. So a place gets no more rows of a kind than there are portions of texts.
    """
    sizes = np.array([len(t) for t in texts])
    tokens = np.concatenate(coded)
    digit_words = min(DIGIT, depth)
    up, down = powers(BASE, len(tokens)), powers(UNBASE, len(tokens))
    digits = rolling(tokens, digit_words, up, down)
    low = np.uint64((1 << PLACE_BITS) - 1)
    best = least((digits & ~low) | np.arange(len(digits), dtype=np.uint64), depth - digit_words + 1) & low
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(doc[: len(best)] == doc[depth - 1 :])  # windows within one text
    begin = np.cumsum(sizes) - sizes
    kind = radix(tokens, at, np.zeros(len(at), np.int64), depth)
    told = at[kind >= 0]
    if len(told):
        first = np.flatnonzero(np.concatenate([[True], (told[1:] != told[:-1] + 1) | (doc[told[1:]] != doc[told[:-1]])]))
        heads, many = told[first], np.diff(np.append(first, len(told)))
        of = doc[heads]
        yield pa.RecordBatch.from_arrays(
            [pa.array(mix(heads.astype(np.uint64) ^ digits[heads]).view(np.int64)), pa.array([ids[k] for k in of.tolist()], pa.int64()), pa.array((heads - begin[of]).astype(np.int32)), pa.array(many.astype(np.int32)), pa.nulls(len(heads), pa.binary())],
            names=["digit", "doc_id", "start", "windows", "words"],
        )
        others = kind < 0
        others[np.flatnonzero(kind >= 0)[np.unique(kind[kind >= 0], return_index=True)[1]]] = True
        at = at[others]
    run = np.concatenate([[True], (best[at[1:]] != best[at[:-1]]) | (at[1:] != at[:-1] + 1)])
    heads = at[run]
    stops = heads + np.diff(np.append(np.flatnonzero(run), len(at))) + depth - 1  # the word after the run's last window
    whole = " ".join([w for t in texts for w in t])
    raw = whole.encode("utf-8", "replace")
    spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    begins, ends = np.concatenate([[0], spaces + 1]), np.append(spaces, len(raw))
    rows = [packer.compress(raw[a:b]) for a, b in zip(begins[heads].tolist(), ends[stops - 1].tolist(), strict=True)]
    of = doc[heads]
    yield pa.RecordBatch.from_arrays(
        [pa.array(digits[best[heads].astype(np.int64)].view(np.int64)), pa.array([ids[k] for k in of.tolist()], pa.int64()), pa.array((heads - begin[of]).astype(np.int32)), pa.array((stops - heads - depth + 1).astype(np.int32)), pa.array(rows, pa.binary())],
        names=["digit", "doc_id", "start", "windows", "words"],
    )


def primed(primer: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    content = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(primer) >= 8 else None
    if content is not None:
        content.precompute_compress(level=1)
        return zstandard.ZstdCompressor(dict_data=content, write_dict_id=False), zstandard.ZstdDecompressor(dict_data=content)
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def first_digits(docs: DataFrame, depth: int, primer: bytes) -> DataFrame:
    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        packer = primed(primer)[0]
        ids, texts, coded, held = [], [], [], 0
        for batch in cut(source):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = words(text) if text else []
                if len(tokens) >= depth:
                    ids.append(i)
                    texts.append(tokens)
                    coded.append(memo.array(tokens))
                    held += len(tokens)
                    if held >= CHUNK:
                        yield from first_pass(ids, texts, coded, depth, packer)
                        ids, texts, coded, held = [], [], [], 0
        if texts:
            yield from first_pass(ids, texts, coded, depth, packer)

    return docs.select("doc_id", "text").mapInArrow(read, "digit long, doc_id long, start int, windows int, words binary")


class Numbers(dict):
    """Word to number, in the order in which they come: equal numbers are equal words."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def unpacked(rows: pa.Table, keep: np.ndarray, numbers: Numbers, unpacker: zstandard.ZstdDecompressor, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the rows `keep`, one row after the other, as numbers; and of each window its first word among these, the place in `keep` of its row, and its place in the row."""
    parts, sizes = [], []
    column = rows.column("words")
    for s in range(0, len(keep), 2000):
        found = [unpacker.decompress(x.as_py()).split(b" ") for x in column.take(pa.array(keep[s : s + 2000]))]
        sizes += map(len, found)
        flat = list(itertools.chain.from_iterable(found))
        parts.append(np.fromiter(map(numbers.__getitem__, flat), np.int32, len(flat)))
    tokens, sizes = np.concatenate(parts), np.array(sizes, np.int64)
    many = sizes - depth + 1
    row = np.repeat(np.arange(len(keep)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return tokens, (np.cumsum(sizes) - sizes)[row] + place, row, place


def radix(tokens: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """The class of each window of `depth` words, or -1 if no other window of its group has the same words.

    Most-significant-digit passes: a pass orders the windows that are left by their next RADIX words; those whose words up to there are like no other's drop out. What is left after the last pass are runs of equal windows. A digit is compared by a hash of its words; the runs are compared word by word at the end.
    """
    spread = mix(tokens.astype(np.uint64) + np.uint64(1))
    up, down = powers(BASE, len(tokens)), powers(UNBASE, len(tokens))
    left, of = np.arange(len(at)), group
    for d in range(0, depth, RADIX):
        key = rolling(spread, min(RADIX, depth - d), up, down)[at[left] + d]
        order = np.lexsort((key, of))
        key, sorted_of, left = key[order], of[order], left[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (sorted_of[1:] != sorted_of[:-1])]) if len(left) else np.zeros(0, bool)
        number = np.cumsum(new)
        many = np.bincount(number, minlength=1)[number] > 1
        left, of = left[many], number[many]
        if not len(left):
            break
    out = np.full(len(at), -1, np.int64)
    out[left] = of
    a, b = at[left[:-1]], at[left[1:]]
    same = of[1:] == of[:-1]
    differ = np.zeros(len(same), bool)
    for k in range(depth if len(left) else 0):
        differ |= tokens[a + k] != tokens[b + k]
    if (differ & same).any():  # digits that are alike by their hashes only
        exact: dict[tuple, list[int]] = {}
        for x in left.tolist():
            exact.setdefault((out[x], tokens[at[x] : at[x] + depth].tobytes()), []).append(x)
        for n, members in enumerate(exact.values()):
            out[members] = n if len(members) > 1 else -1
    return out


def stretches(rows: pa.Table, keep: np.ndarray, of: np.ndarray, place: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch | None:
    """The repeated windows as stretches (doc_id, start, stop) in words, stop being the last window's start plus 1."""
    hit = np.flatnonzero(repeated)
    if not len(hit):
        return None
    begin = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])])
    heads = hit[begin]
    lengths = np.diff(np.append(np.flatnonzero(begin), len(hit)))
    start = rows.column("start").to_numpy()[keep[of[heads]]] + place[heads]
    ids = rows.column("doc_id").take(pa.array(keep[of[heads]])).combine_chunks()
    return pa.RecordBatch.from_arrays([ids, pa.array(start.astype(np.int32)), pa.array((start + lengths).astype(np.int32))], names=["doc_id", "start", "stop"])


def later_passes(parts: list[pa.RecordBatch], depth: int, unpacker: zstandard.ZstdDecompressor) -> pa.RecordBatch | None:
    """Of rows in the order of their places, the stretches of windows that are equal to another window of their place."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    digit = rows.column("digit").to_numpy()
    group = np.cumsum(np.concatenate([[True], digit[1:] != digit[:-1]]))
    # equal windows of a text were told before, so a place's only row holds no repeat
    keep = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(keep):
        return None
    tokens, at, of, place = unpacked(rows, keep, Numbers(), unpacker, depth)
    return stretches(rows, keep, of, place, radix(tokens, at, group[keep][of], depth) >= 0)


class HotPlace:
    """The passes over a place that has very many rows: they are sorted as they come, together with one window of each kind that came before."""

    def __init__(self, depth: int, unpacker: zstandard.ZstdDecompressor):
        self.depth, self.unpacker, self.numbers = depth, unpacker, Numbers()
        self.words, self.start, self.told = np.zeros((0, depth), np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
        self.ids = pa.array([], pa.int64())

    def take(self, part: pa.RecordBatch) -> list[pa.RecordBatch]:
        rows = pa.Table.from_batches([part]).combine_chunks()
        keep = np.arange(rows.num_rows)
        if not len(keep):
            return []
        tokens, at, of, place = unpacked(rows, keep, self.numbers, self.unpacker, self.depth)
        held = len(self.words)
        all_at = np.concatenate([np.arange(held) * self.depth, at + held * self.depth])
        kind = radix(np.concatenate([self.words.reshape(-1), tokens]), all_at, np.zeros(len(all_at), np.int64), self.depth)
        late = np.flatnonzero((kind[:held] >= 0) & ~self.told)  # held windows that are now found to be repeated
        self.told[late] = True
        out = [pa.RecordBatch.from_arrays([self.ids.take(pa.array(late)), pa.array(self.start[late]), pa.array(self.start[late] + np.int32(1))], names=["doc_id", "start", "stop"])] if len(late) else []
        own = kind[held:]
        if (found := stretches(rows, keep, of, place, own >= 0)) is not None:
            out.append(found)
        fresh = (own >= 0) & ~np.isin(own, kind[:held][kind[:held] >= 0])
        first = np.sort(np.concatenate([np.flatnonzero(own < 0), np.flatnonzero(fresh)[np.unique(own[fresh], return_index=True)[1]]]))
        self.words = np.concatenate([self.words, tokens[at[first][:, None] + np.arange(self.depth)]])
        self.start = np.concatenate([self.start, (rows.column("start").to_numpy()[of[first]] + place[first]).astype(np.int32)])
        self.told = np.concatenate([self.told, own[first] >= 0])
        self.ids = pa.concat_arrays([self.ids, rows.column("doc_id").take(pa.array(of[first])).combine_chunks()])
        return out


def repeated_windows(docs: DataFrame, depth: int) -> DataFrame:
    """Stretches (doc_id, start, stop) of windows that occur more than once."""
    some = docs.where("text is not null").select("text").limit(300).collect()
    primer = " ".join(" ".join(words(r["text"][:5000])) for r in some).encode("utf-8", "replace")[:PRIMER]

    def sort(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = primed(primer)[1]
        held: list[pa.RecordBatch] = []  # whole places, and what has come of the last one
        hot: HotPlace | None = None
        for batch in source:
            alone = pc.is_null(batch.column(4))
            if pc.any(alone).as_py():
                found = batch.filter(alone)
                yield pa.RecordBatch.from_arrays([found.column(1), found.column(2), pc.add(found.column(2), found.column(3))], names=["doc_id", "start", "stop"])
                batch = batch.filter(pc.invert(alone))
            if not batch.num_rows:
                continue
            digit = batch.column(0).to_numpy()
            if held and held[-1].column(0)[-1].as_py() != digit[0]:
                if hot is None and (out := later_passes(held, depth, unpacker)) is not None:
                    yield out
                held, hot = [], None
            cut = int(np.searchsorted(digit, digit[-1], side="left"))  # the last place may go on in the next batch
            if cut:
                go_on = int(np.searchsorted(digit, digit[0], side="right")) if hot is not None else 0
                if go_on:
                    yield from hot.take(batch.slice(0, go_on))
                rest = batch.slice(go_on, cut - go_on)
                if (held if hot is None else []) or rest.num_rows:
                    if (out := later_passes([*(held if hot is None else []), rest], depth, unpacker)) is not None:
                        yield out
                held, hot = [], None
            last = batch.slice(cut)
            if hot is not None:
                yield from hot.take(last)
                held = [last.slice(0, 1)]  # its place
            else:
                held.append(last)
                if sum(h.num_rows for h in held) > HOT:
                    hot = HotPlace(depth, unpacker)
                    for h in held:
                        yield from hot.take(h)
                    held = [last.slice(0, 1)]
        if held and hot is None and (out := later_passes(held, depth, unpacker)) is not None:
            yield out

    return first_digits(docs, depth, primer).repartition("digit").sortWithinPartitions("digit").mapInArrow(sort, "doc_id long, start int, stop int")


def repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the maximal stretches of each document that are covered by repeated windows of `depth` words.

    Suffixes of all texts (in lower-case words) are ordered through their first `depth` words only. They are distributed so that equal ones meet: by the least run of DIGIT words that begins among them, which successive suffixes mostly have in common, so that they travel in one row with their words. Where they meet, most-significant-digit passes of RADIX words order them; a suffix that is like no other so far takes part in no later pass. The groups that are left are equal word by word, so they are exactly the repeated windows, in one document or several.

    Null texts and texts of fewer than `depth` words have no window; an empty table has none. Documents with a null doc_id count as places of repeats but aren't reported; rows with the same doc_id, repeated rows among them, are reported together. Very long texts are sorted whole. There are no ties: all members of a group are reported. Other columns, of any name, are ignored.
    """
    found = repeated_windows(docs, depth).where("doc_id is not null").select("doc_id", "start", (F.col("stop") + F.lit(depth - 1)).alias("end"))
    by_doc = Window.partitionBy("doc_id").orderBy("start", "end")
    fresh = F.coalesce(F.col("start") > F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    stretches = found.withColumn("fresh", fresh.cast("int")).withColumn("stretch", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        stretches.groupBy("doc_id", "stretch")
        .agg(F.min("start").cast("int").alias("start_word"), F.max("end").cast("int").alias("end_word"))
        .select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).cast("int").alias("n_words"))
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH t AS (SELECT doc_id, REGEXP_EXTRACT_ALL(LOWER(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, UNNEST(w) AS word, UNNEST(RANGE(LEN(w))) AS pos, LEN(w) AS n FROM t WHERE LEN(w) >= {DEPTH}),
k AS (
  SELECT doc_id, pos, n, MD5(STRING_AGG(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {DEPTH - 1} FOLLOWING)) AS k
  FROM u),
v AS (SELECT * FROM k WHERE pos <= n - {DEPTH}),
r AS (SELECT doc_id, pos FROM v WHERE k IN (SELECT k FROM v GROUP BY k HAVING COUNT(*) > 1)),
b AS (SELECT doc_id, pos, CASE WHEN pos > LAG(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {DEPTH} THEN 1 ELSE 0 END AS fresh FROM r),
s AS (SELECT doc_id, pos, SUM(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS stretch FROM b)
SELECT doc_id, MIN(pos)::INT AS start_word, (MAX(pos) + {DEPTH})::INT AS end_word, (MAX(pos) + {DEPTH} - MIN(pos))::INT AS n_words
FROM s GROUP BY doc_id, stretch
"""
