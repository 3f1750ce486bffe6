"""A quality classifier that compares compressed sizes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table

SAMPLE = 600  # labelled texts of a class, at most: two thirds make the dictionary, one third calibrates
SAMPLE_CHARS = 4_000_000  # of a class's sample, at most, but for its last text
DICTIONARY = 448 * 1024  # bytes of a class's dictionary: the texts of the sample share it evenly
BLOCK = 1024  # bytes that are compressed at once, so that the dictionary counts throughout a long text
LEVEL = 3
KEEP = 0.5  # least score of a text that is kept


class Judge:
    """Dictionaries of good and bad text, and the logistic curve that turns size differences into scores."""

    def __init__(self, good: bytes, bad: bytes, slope: float = 0.0, offset: float = 0.0):
        self.good, self.bad, self.slope, self.offset = good, bad, slope, offset
        self._packers: list[zstandard.ZstdCompressor] | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_packers"} | {"_packers": None}

    def difference(self, text: str) -> float:
        """(bytes with the bad dictionary - bytes with the good one) / their sum, over all blocks of the text: above 0 for text like the good."""
        if self._packers is None:
            self._packers = []
            for content in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._packers.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        raw = text.encode("utf-8", "replace")
        blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
        good, bad = (sum(len(p.compress(b)) for b in blocks) for p in self._packers)
        return (bad - good) / (bad + good)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.difference(text) + self.offset, -50, 50))))


def logistic(x: np.ndarray, y: np.ndarray, good: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (x, 0 or 1), the ones weighing `good` of the whole, by Newton's method with a slight ridge."""
    spread = float(x.std()) or 1.0
    design = np.stack([x / spread, np.ones_like(x)], axis=1)
    weight = np.where(y == 1, good / max(1, (y == 1).sum()), (1 - good) / max(1, (y == 0).sum()))
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -50, 50)))
        slope = design.T @ (weight * (y - p)) - 1e-4 * b
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / spread), float(b[1])


def dictionary(texts: list[str]) -> bytes:
    """As much of each text as fits when all of them share DICTIONARY bytes, cut from places spread over it."""
    share = max(64, DICTIONARY // max(1, len(texts)))
    parts = []
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        start = (k * 7919) % max(1, len(raw) - share + 1)
        parts.append(raw[start : start + share])
    return b"\n".join(parts)[-DICTIONARY:]


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[int, str]], float]:
    """(quality, text) of at most SAMPLE labelled documents of a class, chosen by a hash of doc_id, and the share of good ones among all labels. A document with labels of both kinds has none. The bounds SAMPLE and SAMPLE_CHARS are of labelled rows only."""
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"), F.min("quality").alias("least")).where("q = least").select(F.col("doc_id").alias("of"), "q")
    counts = {r["q"]: r["n"] for r in marks.groupBy("q").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return [], 0.5
    chosen = marks.where(" or ".join(f"(q = {q} and pmod(xxhash64(of), {max(1, n // (2 * SAMPLE))}) = 0)" for q, n in counts.items()))
    usable = docs.where("text is not null and length(trim(text)) > 0")
    sizes = usable.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("chars")).join(chosen, F.col("doc_id") == F.col("of")).select("of", "q", "h", "chars").collect()
    picked = []
    for q in (0, 1):  # by size alone, so that no text beyond the bounds comes to the driver
        chars = taken = 0
        for r in sorted((r for r in sizes if r["q"] == q), key=lambda r: (hash_of(r["of"]), r["h"])):
            if taken < SAMPLE and chars < SAMPLE_CHARS:
                taken += 1
                chars += r["chars"]
                picked.append((r["of"], r["h"], q))
    if not picked:
        return [], 0.5
    # at most 2 * SAMPLE rows
    wanted = docs.sparkSession.createDataFrame(sorted(set(picked)), "of long, w bigint, q int")
    rows = usable.select("doc_id", "text").join(F.broadcast(wanted), (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("w"))).select("of", "text", "q").distinct().collect()
    rows.sort(key=lambda r: (r["q"], hash_of(r["of"]), r["text"]))
    return [(r["q"], r["text"]) for r in rows], counts[1] / (counts[0] + counts[1])


def hash_of(n: int) -> int:
    return (n * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF


def train(rows: list[tuple[int, str]], good: float = 0.5) -> Judge | None:
    """`good` is the share of good texts among all. Two texts of three make the dictionaries, the third calibrates. None if a class has fewer than three texts."""
    of = {q: [t for k, t in rows if k == q] for q in (0, 1)}
    if min(map(len, of.values())) < 3:
        return None
    judge = Judge(*(dictionary([t for k, t in enumerate(of[q]) if k % 3]) for q in (1, 0)))
    held = [(judge.difference(t), q) for q in (0, 1) for k, t in enumerate(of[q]) if k % 3 == 0]
    judge.slope, judge.offset = logistic(np.array([x for x, _ in held]), np.array([q for _, q in held]), good)
    return judge


def classify(docs: DataFrame, judge: Judge | None) -> DataFrame:
    """(doc_id, difference, score, keep) of every document.

    A text is compressed in blocks of BLOCK bytes, all of it, with zstandard dictionaries of good and of bad labelled text; `difference` is the normalised difference of the compressed sizes and `score` its calibrated probability of good quality, both rounded to six places. A text is kept from a score of KEEP. The dictionaries hold DICTIONARY bytes, an even share of each labelled text of the sample. Null and empty texts have no difference and no score and aren't kept; without labels of both classes nothing has a score and everything else is kept. Rows are judged one by one, whatever their doc_id, so repeated rows and ties get equal verdicts; very long texts are compressed whole; an empty table gives an empty one; other columns, of any name, are ignored.
    """

    def one(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"difference": [], "score": [], "keep": []}
        for text in batch.column(1).to_pylist():
            if not text or judge is None:
                row = None, None, bool(text)
            else:
                d = judge.difference(text)
                s = float(1 / (1 + np.exp(-np.clip(judge.slope * d + judge.offset, -50, 50))))
                row = round(d, 6), round(s, 6), s >= KEEP
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {"doc_id": batch.column(0)} | out

    return batches(docs.select("doc_id", "text"), one, "doc_id long, difference double, score double, keep boolean")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(*sample(docs, table(spark, sf_dir, "labels"))))
