"""Word-level language identification with a linear-chain conditional random field."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, cut, kept, table, words

SAMPLE_DOCS = 300  # labelled documents of a language that the field is fitted on, at most
SAMPLE_WORDS = 20_000  # words of a language that it is fitted on, at most
ROUNDS = 80
LEAST_SHARE = 0.5  # of the words, in the posterior mean, that the main language of an accepted text of undeclared language has
LEAST_DECLARED = 0.3  # of the words, that the declared language of an accepted text may have, so that code-switched texts stay
DEVIATIONS = 1.5  # by which the share of a text's words may fall short of what it has in texts like it
SEED = 7


def features(word: str) -> list[str]:
    """Affixes up to three letters, letter pairs and triples with the word's bounds, and its shape."""
    if word.isdigit():
        return []
    marked = f"^{word}$"
    found = {marked[k : k + n] for n in (2, 3) for k in range(len(marked) - n + 1)}
    found.update((f"<{word[:1]}", f"<{word[:2]}", f"<{word[:3]}", f"{word[-1:]}>", f"{word[-2:]}>", f"{word[-3:]}>"))
    if not word.isascii():
        found.add("=wide")
    if not word.isalpha():
        found.add("=mixed")
    return list(found)


def flows(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pass_on: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward messages of many chains at once, and the forward scales.

    Words of all chains lie one after another in `e` (emission potentials); all chains advance together, and drop out as they end.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()
    at = np.empty(len(e), np.int64)  # words by their place in the chain, so that each step works on a slice
    offsets = [0]
    for t, n in enumerate(active):
        np.add(starts[:n], t, out=at[offsets[-1] : offsets[-1] + n])
        offsets.append(offsets[-1] + n)
    e = e[at]
    ones = np.ones(e.shape[1], e.dtype)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones(len(e), e.dtype)
    a = None
    for t, n in enumerate(active):
        here = slice(offsets[t], offsets[t + 1])
        a = e[here] * (first if t == 0 else a[:n] @ pass_on)
        total = a @ ones
        a /= total[:, None]
        alpha[here], scale[here] = a, total
    back = np.ascontiguousarray(pass_on.T)
    for t in range(longest - 1, 0, -1):
        n, o = active[t], offsets[t]
        beta[offsets[t - 1] : offsets[t - 1] + n] = ((beta[o : o + n] * e[o : o + n]) @ back) / scale[o : o + n, None]
    out = np.empty_like(alpha), np.empty_like(beta), np.empty_like(scale)
    for to, of in zip(out, (alpha, beta, scale), strict=True):
        to[at] = of
    return out


class Numbers(dict):
    """Word to the number of its row of potentials; words met for the first time are listed in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


AT_ONCE = 300_000  # words
MOST_KNOWN = 500_000  # words whose potentials a worker keeps; more empty the table, which changes no result
KEEP = "language"  # the name under which a worker keeps the table from task to task


class Field:
    """A fitted conditional random field: weights of features by label, transitions and starts."""

    def __init__(self, labels: list[str], index: dict[str, int], lexicon: dict[str, int], weights: np.ndarray, moves: np.ndarray, first: np.ndarray):
        self.labels, self.index, self.lexicon, self.weights, self.moves, self.first = labels, index, lexicon, weights, moves, first
        self.key = xxhash.xxh128_digest(weights.tobytes() + moves.tobytes())

    def numbers(self, word: str) -> list[int]:
        index = self.index
        out = [n for f in features(word) if (n := index.get(f)) is not None]
        if (label := self.lexicon.get(word)) is not None:
            out.append(label)  # the first features are the lexicons
        return out

    def rows_of(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """For the words of each text, rows of the table of emission potentials, and that table. Each distinct word is scored once, and kept from batch to batch."""
        key, known, rows = kept.get(KEEP, (None, None, None))
        if key != self.key or len(known) > MOST_KNOWN:
            kept.pop(KEEP, None)
            known, rows = Numbers(), np.zeros((0, len(self.labels)), np.float32)
        at, parts = [], [rows]
        for text in texts:
            tokens = words(text) if text else []
            at.append(np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)))
            if len(known.fresh) > 50_000:
                parts.append(self.score(known))
        parts.append(self.score(known))
        kept[KEEP] = self.key, known, np.concatenate(parts)
        return at, kept[KEEP][2]

    def score(self, known: Numbers) -> np.ndarray:
        lists, known.fresh = [self.numbers(w) for w in known.fresh], []
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
        new = np.zeros((len(lists), len(self.labels)))
        if len(flat):
            some = sizes > 0
            new[some] = np.add.reduceat(self.weights[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
        return np.exp(new - new.max(axis=1, keepdims=True, initial=-np.inf)).astype(np.float32)

    def posteriors(self, chains: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Label probabilities of all words of the chains, none of which is empty."""
        sizes = np.fromiter(map(len, chains), np.int64, len(chains))
        alpha, beta, _ = flows(rows[np.concatenate(chains)], np.cumsum(sizes) - sizes, sizes, np.exp(self.moves).astype(np.float32), np.exp(self.first).astype(np.float32))
        alpha *= beta
        alpha /= (alpha @ np.ones(alpha.shape[1], alpha.dtype))[:, None]
        return alpha


Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def summaries(field: Field, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[Runs]]:
    """The words of each text, its mean label probabilities, and the runs of words with the same likeliest label (first word, word after the last, label). Chains of similar length are worked on together, about AT_ONCE words at a time."""
    at, rows = field.rows_of(texts)
    sizes = np.fromiter(map(len, at), np.int64, len(at))
    none = np.zeros(0, np.int64)
    shares, runs = np.zeros((len(at), len(field.labels))), [(none, none, none)] * len(at)
    order = [k for k in np.argsort(sizes, kind="stable").tolist() if sizes[k]]
    while order:
        part, held = [], 0
        while order and held < AT_ONCE:
            part.append(order.pop())
            held += sizes[part[-1]]
        p = field.posteriors([at[k] for k in part], rows)
        starts = np.cumsum(sizes[part]) - sizes[part]
        shares[part] = np.add.reduceat(p, starts, axis=0, dtype=np.float64) / sizes[part][:, None]
        best = p.argmax(axis=1)
        changed = np.concatenate([[True], best[1:] != best[:-1]])
        changed[starts] = True
        first = np.flatnonzero(changed)
        last, label = np.append(first[1:], len(best)), best[first]
        bounds = np.searchsorted(first, np.append(starts, len(best))).tolist()
        for j, k in enumerate(part):
            of = slice(bounds[j], bounds[j + 1])
            runs[k] = first[of] - starts[j], last[of] - starts[j], label[of]
    return sizes, shares, runs


def reached(share: float, n: int) -> float:
    """The greatest share of a language of which `share` of n words is at most DEVIATIONS standard deviations short (Wilson's bound): little evidence rules little out."""
    z2 = DEVIATIONS * DEVIATIONS
    return (share + z2 / (2 * n) + DEVIATIONS * math.sqrt(max(0.0, share * (1 - share) / n + z2 / (4 * n * n)))) / (1 + z2 / n)


def fit(rows: list[tuple[str, str]]) -> Field:
    """Fits the field to (language, text) rows by gradient ascent (Adam) on the conditional log-likelihood.

    Pieces of 10 to 40 words of the labelled texts are joined into chains of three, so that languages change within a chain and transitions are learnt.
    """
    rng = np.random.default_rng(SEED)
    labels = sorted({lang for lang, _ in rows})
    pieces: list[tuple[int, list[str]]] = []
    for k, lang in enumerate(labels):
        left = SAMPLE_WORDS
        for of, text in rows:
            if of == lang and left > 0:
                tokens = words(text)[:left]
                left -= len(tokens)
                while tokens:
                    n = int(rng.integers(10, 41))
                    pieces.append((k, tokens[:n]))
                    tokens = tokens[n:]
    order = rng.permutation(len(pieces))
    joined = [[pieces[j] for j in order[i : i + 3]] for i in range(0, len(order), 3)]
    texts = [[w for _, p in c for w in p] for c in joined]
    truth = np.array([k for c in joined for k, p in c for _ in p], np.int64)
    seen: dict[str, Counter] = defaultdict(Counter)
    for w, k in zip((w for t in texts for w in t), truth, strict=True):
        seen[w][int(k)] += 1
    lexicon = {}
    for w, c in seen.items():
        (k, n), total = c.most_common(1)[0], sum(c.values())
        if n >= 3 and n >= 0.9 * total:
            lexicon[w] = k
    index: dict[str, int] = {}
    counts = Counter(f for w in seen for f in features(w))
    for f, n in sorted(counts.items()):
        if n >= 2:
            index[f] = len(labels) + len(index)
    n_labels = len(labels)
    field = Field(labels, index, lexicon, np.zeros((n_labels + len(index), n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    vocabulary = {w: k for k, w in enumerate(seen)}
    lists = [field.numbers(w) for w in vocabulary]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
    of_word = np.repeat(np.arange(len(lists)), sizes)
    word = np.array([vocabulary[w] for t in texts for w in t], np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(word), bool)
    inner[starts] = False
    follows = np.flatnonzero(inner)
    gold = np.eye(n_labels)[truth]
    gold_moves = np.zeros((n_labels, n_labels))
    np.add.at(gold_moves, (truth[follows - 1], truth[follows]), 1)
    parameters = [field.weights, field.moves, field.first]
    first_moment = [np.zeros_like(p) for p in parameters]
    second_moment = [np.zeros_like(p) for p in parameters]

    def spread(values: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(where, values[:, k], n) for k in range(n_labels)], axis=1)

    for step in range(1, ROUNDS + 1):
        scores = spread(field.weights[flat], of_word, len(lists))
        e = np.exp(scores - scores.max(axis=1, keepdims=True))[word]
        pass_on = np.exp(field.moves)
        alpha, beta, scale = flows(e, starts, lengths, pass_on, np.exp(field.first))
        p = alpha * beta
        p /= p.sum(axis=1, keepdims=True)
        pairs = alpha[follows - 1][:, :, None] * pass_on[None] * ((e * beta)[follows] / scale[follows][:, None])[:, None, :]
        by_word = spread(gold - p, word, len(lists))
        slopes = [
            spread(by_word[of_word], flat, len(field.weights)) / len(word) - 1e-6 * field.weights,
            (gold_moves - (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)) / len(word),
            (gold[starts] - p[starts]).sum(axis=0) / len(word),
        ]
        for q, g, m, v in zip(parameters, slopes, first_moment, second_moment, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


def labelled_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, text) of at most SAMPLE_DOCS documents of each language, chosen by a hash of doc_id and text."""
    usable = docs.where("lang is not null and text is not null and length(trim(text)) > 0").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    step = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, max(1, n // (2 * SAMPLE_DOCS)))])
    rows = usable.where(F.pmod("h", step[F.col("lang")]) == 0).collect()
    taken: Counter = Counter()
    out = []
    for r in sorted(rows, key=lambda r: (r["h"], r["text"])):
        if taken[r["lang"]] < SAMPLE_DOCS:
            taken[r["lang"]] += 1
            out.append((r["lang"], r["text"]))
    return out


SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("language", pa.string())]))


def spans_of(field: Field | None, runs: list[Runs]) -> pa.Array:
    """For each text the runs of words in a language: first word, last word, language."""
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])]).astype(np.int32))
    first, last, label = (np.concatenate([r[k] for r in runs]) if runs else np.zeros(0, np.int64) for k in range(3))
    names = pa.array(field.labels if field else [], pa.string()).take(pa.array(label)) if len(label) else pa.array([], pa.string())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last - 1, pa.int32()), names], fields=list(SPANS.value_type)))


def verdicts(field: Field | None, texts: list[str | None], declared: list[str | None]) -> dict:
    """Of each text: its main language, that language's share of the words, the next one and its share, the changes of language, the words, whether it is accepted, and the runs of words by language."""
    out: dict = {n: [] for n in ("language", "share", "second", "second_share", "switches", "n_words", "accepted")}
    if field is None:
        for t in texts:
            for n, v in zip(out, (None, None, None, None, 0, len(words(t)) if t else 0, False), strict=True):
                out[n].append(v)
        return out | {"spans": spans_of(None, [(np.zeros(0, np.int64),) * 3] * len(texts))}
    sizes, shares, runs = summaries(field, texts)
    ranked = np.argsort(-shares, axis=1, kind="stable")
    for k, n in enumerate(sizes.tolist()):
        if not n:
            row = (None, None, None, None, 0, 0, False)
        else:
            share, main, second = shares[k], ranked[k, 0], ranked[k, 1] if len(field.labels) > 1 else None
            known = declared[k] in field.labels
            fits = reached(float(share[field.labels.index(declared[k])]), n) >= LEAST_DECLARED if known else share[main] >= LEAST_SHARE
            row = (field.labels[main], round(float(share[main]), 6), None if second is None else field.labels[second], None if second is None else round(float(share[second]), 6), len(runs[k][0]) - 1, n, bool(fits))
        for name, v in zip(out, row, strict=True):
            out[name].append(v)
    return out | {"spans": spans_of(field, runs)}


def identify(docs: DataFrame, field: Field | None) -> DataFrame:
    """Per document (doc_id, lang, language, share, second, second_share, switches, n_words, accepted, spans).

    Every word gets label probabilities from the field by forward-backward over the whole text; `spans` are the runs of words of one likeliest language, which cover the text. A text is accepted if the language it is declared to be in may have LEAST_DECLARED of the words: if the share that it has in the posterior mean is at most DEVIATIONS standard deviations short of that, at any length, so a text that switches to another language stays, and so does one of a few words that tell little. With a null or unknown declaration, the main language must have LEAST_SHARE of the words. Null, empty and wordless texts have no language and no span and aren't accepted, nor is anything where no text is labelled; an empty table gives an empty one. Ties go to the language that is first in the alphabet. Very long texts are labelled whole. Rows with repeated or null doc_ids are judged one by one; other columns, of any name, are ignored.
    """

    def one(batch: pa.RecordBatch) -> dict:
        ids, lang = batch.column(0), batch.column(2)
        return {"doc_id": ids, "lang": lang} | verdicts(field, batch.column(1).to_pylist(), lang.to_pylist())

    return batches(docs.select("doc_id", "text", "lang"), one, "doc_id long, lang string, language string, share double, second string, second_share double, switches int, n_words int, accepted boolean, spans array<struct<first:int,last:int,language:string>>", KEEP)


def train(docs: DataFrame) -> Field | None:
    """The field fitted on a bounded sample of the documents' own language labels; None if there is no labelled text."""
    rows = [r for r in labelled_sample(docs) if words(r[1])]
    return fit(rows) if rows else None


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def keep_accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is accepted, with all their columns, decided row by row as in `identify`: null, empty and wordless texts go, repeated rows stay or go together, an empty table stays empty; other columns may have any name."""
    field = train(docs)
    names = docs.columns
    text, lang = names.index("text"), names.index("lang")

    def run(source):
        for batch in cut(source, KEEP):
            good = verdicts(field, batch.column(text).to_pylist(), batch.column(lang).to_pylist())["accepted"]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
