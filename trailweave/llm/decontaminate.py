"""Benchmark decontamination by latent semantic retrieval."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix, small, table, words, written

TERMS = 1 << 14  # hashed terms, the columns of the TF-IDF matrix
RANK = 64  # of the randomised singular value decomposition
PASSAGE = 32  # words in a passage, the rows of the matrix
CHUNK = 1 << 16  # words that are worked on at once
BLOCK = 4  # words in the smallest step of a window
SMALLEST = 8  # words in the smallest window
LEAST_COSINE = 0.25  # of a candidate
LEAST_ITEM = 8  # words of an item that is looked for reworded; shorter ones are looked for verbatim
LEAST_COVER = 0.6  # of an item's words, in order, that a contaminated passage has
LEAST_ANSWER = 0.5  # of the words of the item's last quarter, in order, that it has
ITEMS = 20_000  # of a round, and
ITEM_CHARS = 64_000_000  # their characters, on average: what is broadcast stays about so large
PARTS = 64  # of the sketch
BATCH = 32 << 20  # bytes of a record batch that are taken at once, and then worked on in portions: words that many texts share are split once a portion


def test_matrix() -> np.ndarray:
    """Random signs (TERMS, RANK). Signs keep all sums whole, so no order of summation changes the result."""
    return np.random.default_rng(12345).integers(0, 2, (TERMS, RANK), dtype=np.int8) * 2 - 1


def portions(texts: pa.Array, most: int = 6_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about `most` bytes together, so that a batch's tokens aren't all held at once."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
    start = 0
    while start < len(sizes):
        stop = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most)) + 1
        yield start, min(stop, len(sizes))
        start = stop


def hashes(strings: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each string's bytes, worked out for all of them at once."""
    n = len(strings)
    bounds = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + n + 1] if n else np.zeros(1, np.int32)
    sizes = np.diff(bounds).astype(np.int64)
    data = np.frombuffer(strings.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    place = np.arange(len(data)) - np.repeat(bounds[:-1] - bounds[0], sizes)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(sizes.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place], dtype=np.uint64)])
        ends = bounds - bounds[0]
        return mix(sums[ends[1:]] - sums[ends[:-1]] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The lower-case words of texts: `codes`, hashes of words, and of each text the numbers of its words in them. Number len(codes) stands for no word."""

    def __init__(self, texts: pa.Array):
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("")))
        coded = lists.flatten().dictionary_encode()
        bare = pc.ascii_trim(pc.replace_substring_regex(coded.dictionary, r"[^\pL\pN_]+", " "), " ")
        found = pc.split_pattern(bare, " ")  # a token between white space mostly is one word
        some = pc.not_equal(bare, "").to_numpy(zero_copy_only=False)
        sizes = np.where(some, pc.list_value_length(found).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        self.codes = hashes(found.filter(pa.array(some)).flatten())
        flat = np.arange(len(self.codes), dtype=np.int32)
        token = coded.indices.to_numpy()
        each = sizes[token]
        ends = np.cumsum(each)
        self.numbers = flat[np.repeat((np.cumsum(sizes) - sizes)[token] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        tokens = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        self.offsets = np.concatenate([[0], ends])[tokens]
        self.texts = [self.numbers[x:y] for x, y in itertools.pairwise(self.offsets.tolist())]

    def terms(self) -> np.ndarray:
        """The hashed term of each word number, TERMS for no word."""
        return np.append((self.codes & np.uint64(TERMS - 1)).astype(np.int32), np.int32(TERMS))


def item_terms(text: str) -> np.ndarray:
    found = Words(pa.array([text], pa.string()))
    return found.terms()[found.texts[0]]


def chunked(texts: list[np.ndarray], unit: int, overlap: int, filler: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """The texts' words in arrays of about CHUNK, or twice the overlap if that is more, each text's part filled up to a multiple of `unit`, and the parts: (text, its first word, place in the array, words). Longer texts are cut in parts that overlap."""
    size = max(CHUNK, 2 * overlap)
    arrays, parts, at = [], [], 0
    for k, numbers in enumerate(texts):
        for s in range(0, max(1, len(numbers) - overlap), size - overlap):
            part = numbers[s : s + size]
            if not len(part):
                continue
            fill = -len(part) % unit
            parts.append((k, s, at, len(part)))
            arrays += [part, np.full(fill, filler, np.int32)]
            at += len(part) + fill
            if at >= size:
                yield np.concatenate(arrays), parts
                arrays, parts, at = [], [], 0
    if parts:
        yield np.concatenate(arrays), parts


LANE = 21  # bits: a passage adds at most PASSAGE to a column, a chunk has CHUNK // PASSAGE of them, and their product is below 2 ** (LANE - 1)


def packed(y: np.ndarray) -> np.ndarray:
    """The columns of y (n, RANK), three to a number, as (lanes, n): sums of such numbers hold the sums of the three."""
    lanes = np.zeros((len(y), -(-RANK // 3), 3), np.int64)
    lanes.reshape(len(y), -1)[:, :RANK] = y
    return np.ascontiguousarray((lanes[:, :, 0] + (lanes[:, :, 1] << LANE) + (lanes[:, :, 2] << 2 * LANE)).T)


def unpacked(x: np.ndarray) -> np.ndarray:
    """What `packed` packed, or sums of it, as (n, RANK)."""
    half = 1 << (LANE - 1)
    low = ((x + half) & (2 * half - 1)) - half
    x = (x - low) >> LANE
    middle = ((x + half) & (2 * half - 1)) - half
    return np.stack([low, middle, (x - middle) >> LANE], axis=2).transpose(1, 0, 2).reshape(x.shape[1], -1)[:, :RANK]


def passages_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The terms of the texts' passages, PASSAGE to each, in arrays of many passages."""
    for a, b in portions(texts):
        found = Words(texts[a:b])
        terms = found.terms()
        for numbers, _ in chunked(found.texts, PASSAGE, 0, len(found.codes)):
            yield terms[numbers]


def sketch(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """One distributed pass over all passages C (rows with 1 for each term that occurs): C'(C Ω), the passages that have each term, and the number of passages.

    A task keeps one table of TERMS x (RANK + 1) whole numbers however much it reads; tables are added up part by part on the way to the driver.
    """
    width = RANK + 1

    def read(source):
        omega = np.concatenate([test_matrix(), np.zeros((1, RANK), np.int8)])
        total = np.zeros((TERMS + 1, width), np.int64)
        passages = 0
        for batch in cut(source, most=BATCH):
            text = batch.column(0)
            for terms in passages_of(text):
                passages += len(terms) // PASSAGE
                by_row = np.sort(terms.reshape(-1, PASSAGE), axis=1)
                by_row[:, 1:][by_row[:, 1:] == by_row[:, :-1]] = TERMS  # a term counts once in a passage
                y = omega[by_row.reshape(-1)].reshape(-1, PASSAGE, RANK).sum(axis=1, dtype=np.int8)
                flat = by_row.reshape(-1).astype(np.uint16)
                order = np.argsort(flat, kind="stable")
                term = flat[order]
                ends = np.flatnonzero(np.concatenate([term[1:] != term[:-1], [True]]))
                there = term[ends]
                total[there, :RANK] += unpacked(np.diff(np.cumsum(np.take(packed(y), order // PASSAGE, axis=1), axis=1)[:, ends], axis=1, prepend=0))
                total[there, RANK] += np.diff(ends, prepend=-1)
        rows = TERMS // PARTS
        blobs = [total[k * rows : (k + 1) * rows].astype(np.int32).tobytes() for k in range(PARTS)] if passages else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array([passages] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "passages", "blob"])

    def add(source):
        sums: dict[int, list] = {}
        for batch in source:
            for part, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                table_of = np.frombuffer(blob.as_buffer(), np.int32)
                if part in sums:
                    sums[part][0] += n
                    sums[part][1] += table_of
                else:
                    sums[part] = [n, table_of.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1].tobytes() for v in sums.values()], pa.binary())], names=["part", "passages", "blob"])

    shape = "part int, passages long, blob binary"
    found = docs.select("text").mapInArrow(read, shape).repartition(PARTS, "part").mapInArrow(add, shape).collect()
    out = np.zeros((TERMS, width), np.int64)
    for r in found:
        out[r["part"] * (TERMS // PARTS) : (r["part"] + 1) * (TERMS // PARTS)] = np.frombuffer(r["blob"], np.int64).reshape(-1, width)
    return out[:, :RANK], out[:, RANK], found[0]["passages"] if found else 0


def term_vectors(gram: np.ndarray, there: np.ndarray, passages: int) -> np.ndarray:
    """(TERMS + 1, RANK) vectors whose sums over a window's words are its place in the latent space.

    With D the diagonal of inverse document frequencies, the TF-IDF matrix is A = C D, and A'A is approximated from the single sketch: A'A ~ (D S)(Ω'S)^-1(D S)' for S = C'CΩ, whose eigenvectors are the right singular vectors of A. Places are divided by the singular values, which evens out what all passages of a language share; the frequency weight is squared for the same reason.
    """
    idf = np.log1p(passages / np.maximum(there, 1.0)) ** 2
    s = gram.astype(np.float64)
    core = test_matrix().astype(np.float64).T @ s
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 1e-12) * 1e-9
    b = (idf[:, None] * s) @ (vectors[:, good] / np.sqrt(values[good]))
    squares, turn = np.linalg.eigh(b.T @ b)
    kept = squares > max(squares.max(initial=0.0), 1e-12) * 1e-9
    sigma = np.sqrt(squares[kept])
    right = b @ (turn[:, kept] / sigma)
    out = np.zeros((TERMS + 1, RANK), np.float32)
    out[:TERMS, : right.shape[1]] = idf[:, None] * right / sigma
    return out


def common_length(masks: dict, n: int, tokens: list) -> int:
    """Length of the longest common subsequence of `tokens` and the n words whose places `masks` has as bits."""
    full = (1 << n) - 1
    v = full
    for w in tokens:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def places_of(tokens: list) -> dict:
    masks: dict = {}
    for k, w in enumerate(tokens):
        masks[w] = masks.get(w, 0) | (1 << k)
    return masks


def span_sums(spans: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Sums of n successive rows of spans[1], which has more than n rows to spare at its end; kept in `spans`."""
    if n not in spans:
        half = n // 2
        a, b = span_sums(spans, half), span_sums(spans, n - half)
        spans[n] = a[: len(b) - half] + b[half:]
    return spans[n]


class Item:
    def __init__(self, item_id: int, tokens: list):
        self.item_id, self.tokens, self.n = item_id, tokens, len(tokens)
        self.masks = places_of(tokens)
        self.answer = tokens[-max(1, len(tokens) // 4) :]
        self.answer_masks = places_of(self.answer)
        self.window = SMALLEST  # the least of 8, 12, 16, 24, 32, 48, 64, ... that holds the item
        while self.window < self.n:
            self.window = self.window * 3 // 2 if self.window.bit_count() == 1 else self.window * 4 // 3


def runs_hash(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    out = codes[: len(codes) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k]
    return out


class Retriever:
    """Items of a round, by window, with their unit vectors, and those of fewer than LEAST_ITEM words by their number of words. The words of all items are numbered by `vocabulary`, their sorted hashes."""

    def __init__(self, rows: list[tuple[int, str]], vectors: np.ndarray):
        self.vectors = vectors
        self.items: dict[int, list[Item]] = {}
        self.units: dict[int, np.ndarray] = {}
        self.short: dict[int, tuple[np.ndarray, list[tuple[np.ndarray, int]]]] = {}
        all_of = Words(pa.array([t for _, t in rows], pa.string()))
        self.vocabulary, number = np.unique(all_of.codes, return_inverse=True)  # several tokens may be one word
        terms = all_of.terms()
        places: dict[int, list[np.ndarray]] = {}
        short: dict[int, list[tuple[np.ndarray, int]]] = {}
        for (item_id, _), numbers in zip(rows, all_of.texts, strict=True):
            if 0 < len(numbers) < LEAST_ITEM:
                short.setdefault(len(numbers), []).append((all_of.codes[numbers], item_id))
            elif len(numbers):
                item = Item(item_id, number[numbers].tolist())
                self.items.setdefault(item.window, []).append(item)
                places.setdefault(item.window, []).append(vectors[terms[numbers]].sum(axis=0, dtype=np.float64))
        for n, of in short.items():
            hashes = np.array([runs_hash(codes, n)[0] for codes, _ in of], np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.short[n] = hashes[order], [of[k] for k in order]
        for w, p in places.items():
            stack = np.array(p)
            self.units[w] = (stack / np.maximum(np.linalg.norm(stack, axis=1, keepdims=True), 1e-12)).astype(np.float32).T.copy()
        common = np.bincount(np.array([t for of in self.items.values() for i in of for t in set(i.tokens)], np.int64), minlength=len(self.vocabulary))
        self.flat: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for w, of in self.items.items():  # an item's distinct words, those first that few items have, and how often it has them
            uniques = [sorted(i.masks, key=lambda t: (common[t], t)) for i in of]
            sizes = np.array([len(u) for u in uniques])
            self.flat[w] = np.array([t for u in uniques for t in u], np.int64), np.array([i.masks[t].bit_count() for i, u in zip(of, uniques, strict=True) for t in u], np.int64), np.cumsum(sizes) - sizes, sizes

    def possible(self, word: np.ndarray, at: np.ndarray, length: int) -> dict[int, tuple[int, np.ndarray]]:
        """By window, the size of a cell and, by item and cell, whether a region of twice the window that begins in that cell may have LEAST_COVER of the item: that cell and the next together have enough of its words. `word` are the array's words of the vocabulary and `at` their places."""
        out: dict[int, tuple[int, np.ndarray]] = {}
        cells: dict[int, np.ndarray] = {}
        for w, (flat, weight, begin, sizes) in self.flat.items():
            cell = max(2 * w, -(-length // 64))  # so that the cells of a word are the bits of a number
            if cell not in cells:
                bits = np.zeros(len(self.vocabulary), np.uint64)
                np.bitwise_or.at(bits, word, np.uint64(1) << (at // cell).astype(np.uint64))
                cells[cell] = bits | (bits >> np.uint64(1))
            n = np.array([i.n for i in self.items[w]])
            most = np.floor(n * (1 - LEAST_COVER) + 1e-9)
            good = np.zeros((len(n), 64), bool)
            each = max(1, 30_000 // int(sizes.max()))
            for s in range(0, len(n), each):
                x, y = begin[s], begin[min(s + each, len(n)) - 1] + sizes[min(s + each, len(n)) - 1]
                absent = np.unpackbits((~cells[cell][flat[x:y]])[:, None].view(np.uint8), axis=1, bitorder="little")
                good[s : s + each] = np.add.reduceat(absent * weight[x:y, None].astype(np.int32), begin[s : s + each] - x, axis=0) <= most[s : s + each, None]
            out[w] = cell, good
        return out

    def candidates(self, terms: np.ndarray, among: dict[int, np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, its places in the array, numbers of the items among those of the window, cosines) of pairs with at least LEAST_COSINE that no neighbouring window of the item exceeds: its passage is within half a window of the peak. Items are those `among`, or all."""
        if among is not None and not any(len(x) for x in among.values()):
            return
        four = self.vectors[terms].reshape(-1, BLOCK, RANK)
        blocks = four[:, 0].copy()
        for k in range(1, BLOCK):
            blocks += four[:, k]
        spans = {1: np.concatenate([blocks, np.zeros((max(self.units, default=1) // BLOCK, RANK), np.float32)])}
        for w, units in sorted(self.units.items()):
            number = np.arange(units.shape[1]) if among is None else among[w]
            if not len(number):
                continue
            units = units[:, number]
            step = max(1, w // BLOCK // 4)
            z = span_sums(spans, w // BLOCK)[: len(blocks) : step]
            z = z / np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-12)[:, None]
            for first in range(0, units.shape[1], 4096):
                cosines = z @ units[:, first : first + 4096]
                k, j = np.divmod(np.flatnonzero(cosines >= LEAST_COSINE), cosines.shape[1])
                here = cosines[k, j]
                peak = (here >= cosines[np.maximum(k - 1, 0), j]) & (here >= cosines[np.minimum(k + 1, len(z) - 1), j])
                yield w, k[peak] * step * BLOCK, number[first + j[peak]], here[peak]

    def verbatim(self, found: Words) -> Iterator[tuple[int, int, int]]:
        """(text, item_id, words) of the short items that a text has word for word."""
        codes = found.codes[found.numbers] if self.short else np.zeros(0, np.uint64)
        for n, (hashes, items) in self.short.items():
            if len(codes) < n:
                continue
            runs = runs_hash(codes, n)
            first = np.searchsorted(hashes, runs)
            for at in np.flatnonzero((first < len(hashes)) & (hashes[np.minimum(first, len(hashes) - 1)] == runs)).tolist():
                text = int(np.searchsorted(found.offsets, at, side="right")) - 1
                if at + n > found.offsets[text + 1]:
                    continue
                k = int(first[at])
                while k < len(hashes) and hashes[k] == runs[at]:
                    if (items[k][0] == codes[at : at + n]).all():
                        yield text, items[k][1], n
                    k += 1

    def within_reach(self, w: int, item: np.ndarray, low: np.ndarray, high: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
        """Which of the (item, region of the array from low to high) pairs have at least LEAST_COVER of the item's words in the region, in any order; no more words than that can be common. `keys` are the array's words of the vocabulary, word * length + place, in order."""
        flat, weight, begin, sizes = self.flat[w]
        n = np.array([i.n for i in self.items[w]])
        most = np.floor(n * (1 - LEAST_COVER) + 1e-9)  # words of an item that may be missing
        good = np.zeros(len(item), bool)
        for s in range(0, len(item), max(1, 1_000_000 // int(sizes.max()))):  # the pairs' words are looked up about so many at once
            e = s + max(1, 1_000_000 // int(sizes.max()))
            left = np.flatnonzero(high[s:e] - low[s:e] >= n[item[s:e]] - most[item[s:e]]) + s
            missing = np.zeros(len(item[s:e]), np.int64)
            for half in (0, 1):  # the rarer half of the words rules most pairs out
                cut = (sizes[item[left]] + 1) // 2
                count = cut if half == 0 else sizes[item[left]] - cut
                of = np.repeat(np.arange(len(left)), count)
                word = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + (begin[item[left]] + (cut if half else 0))[of]
                base = flat[word] * length
                there = keys[np.searchsorted(keys, base + low[left][of])] < base + high[left][of]
                missing[left - s] += np.bincount(of, np.where(there, 0, weight[word]), len(left)).astype(np.int64)
                left = left[missing[left - s] <= most[item[left]]]
            good[left] = True
        return good

    def leaks(self, found: Words) -> list[tuple[int, int, float, int, float, float]]:
        """(text, item_id, cosine, common words, cover, answer's cover), one for each contaminated text and item."""
        out: dict[tuple[int, int], tuple[float, int, float, float]] = {(k, i): (1.0, n, 1.0, 1.0) for k, i, n in self.verbatim(found)}
        widest = max(self.units, default=SMALLEST)
        terms = found.terms()
        place_of = np.searchsorted(self.vocabulary, found.codes)
        known = np.append(np.where(self.vocabulary[np.minimum(place_of, max(0, len(self.vocabulary) - 1))] == found.codes, place_of, -1), -1) if len(self.vocabulary) else np.full(len(found.codes) + 1, -1)
        for numbers, parts in chunked(found.texts if self.units else [], BLOCK, 2 * widest, len(found.codes)):
            begins = np.array([p[2] for p in parts])
            ends = begins + [p[3] for p in parts]
            word, length = known[numbers], len(numbers) + 1
            at_words = np.flatnonzero(word >= 0)
            keys = np.append(np.sort(word[at_words] * length + at_words), np.iinfo(np.int64).max)
            possible = self.possible(word[at_words], at_words, length)
            for w, at, item, cosine in self.candidates(terms[numbers], {w: np.flatnonzero(good.any(axis=1)) for w, (_, good) in possible.items()}):
                first = np.maximum(np.searchsorted(begins, at, side="right") - 1, 0)
                many = np.searchsorted(begins, at + w, side="left") - first  # texts that the window meets
                pair = np.repeat(np.arange(len(at)), many)
                part = first[pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
                low, high = np.maximum(begins[part], at[pair] - w // 2), np.minimum(ends[part], at[pair] + w + w // 2)
                cell, good = possible[w]
                some = np.flatnonzero(good[item[pair], low // cell])
                for x in some[self.within_reach(w, item[pair[some]], low[some], high[some], keys, length)].tolist():
                    of = self.items[w][item[pair[x]]]
                    k = parts[part[x]][0]
                    old = out.get((k, of.item_id))
                    if old is not None and old[2] == 1 and old[3] == 1:
                        continue
                    region = word[low[x] : high[x]]
                    region = region[region >= 0].tolist()
                    common = common_length(of.masks, of.n, region)
                    if common < LEAST_COVER * of.n:
                        continue
                    answer = common_length(of.answer_masks, len(of.answer), region) / len(of.answer)
                    if answer >= LEAST_ANSWER:
                        new = (float(cosine[pair[x]]), common, common / of.n, answer)
                        out[k, of.item_id] = new if old is None or new[1:] > old[1:] else old
        return [(k, i, *v) for (k, i), v in out.items()]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, common_words, cover, answer_cover) for each document that has a passage of a benchmark item, verbatim or reworded.

    All passages of the documents make a TF-IDF matrix over hashed terms, decomposed by a distributed randomised SVD in one pass. In a second pass every window of a document, of a size like the item's, is compared with the items by cosine in the latent space; the candidates are verified by the longest common subsequence with the item (LEAST_COVER of its words) and with its answer, the last quarter (LEAST_ANSWER). Items of fewer than LEAST_ITEM words are too short for that and are looked for verbatim, word for word.

    Words are runs of letters, digits and underscores, in documents and items alike. Null and empty texts and documents without a word have no leak; nor have items without a word or with a null item_id or text; empty tables give an empty result. Repeated documents are reported each, repeated items under each item_id; of several passages of an item in one document the one that has most of it is reported, the first of equal ones. Very long texts and items are searched whole. A benchmark of more than ITEMS items or ITEM_CHARS characters is searched in rounds, so what is broadcast stays bounded. Other columns, of any name, are ignored.
    """
    usable = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    size = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    rounds = max(1, -(-size.n // ITEMS), -(-size.chars // ITEM_CHARS))
    vectors = term_vectors(*sketch(docs))
    out = None
    for k in range(rounds):
        part = usable if rounds == 1 else usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k)
        rows = sorted((r["item_id"], r["text"]) for r in part.collect() if words(r["text"]))
        shared = docs.sparkSession.sparkContext.broadcast((rows, vectors))

        def search(source, shared=shared):
            rows, vectors = shared.value
            retriever = Retriever(rows, vectors)
            for batch in cut(source, most=BATCH):
                text = batch.column(1)
                hits = [(a + h[0], *h[1:]) for a, b in portions(text) if rows for h in retriever.leaks(Words(text[a:b]))]
                ids = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[h[0]] for h in hits], pa.int64()),
                        pa.array([h[1] for h in hits], pa.int64()),
                        pa.array([round(h[2], 3) for h in hits], pa.float64()),
                        pa.array([h[3] for h in hits], pa.int32()),
                        pa.array([round(h[4], 6) for h in hits], pa.float64()),
                        pa.array([round(h[5], 6) for h in hits], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "cosine", "common_words", "cover", "answer_cover"],
                )

        found = docs.select("doc_id", "text").mapInArrow(search, "doc_id long, item_id long, cosine double, common_words int, cover double, answer_cover double")
        out = found if out is None else out.unionByName(found)
    return out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text has no benchmark passage, with all their columns. Rows go by their text, whether their doc_id is null, repeated or shared with another text; repeated rows stay or go together. Null and empty texts stay; an empty table or benchmark changes nothing; other columns may have any name."""
    bad = leaks(docs.select(F.xxhash64("text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leaking")).distinct()
    bad = small(written(bad, "leaking"))
    return docs.join(bad, F.xxhash64(docs["text"]) == bad["leaking"], "left_anti")
