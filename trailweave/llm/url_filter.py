"""URL filters by the ratio of two character language models."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, dropped, table, written

ORDER = 6  # longest context, in bytes
MASS = 1.0  # Dirichlet mass of the shorter context's distribution
ALPHABET = 256  # bytes
SCALE = 1_000_000  # of the whole numbers in which gaps are summed, so that no order changes a score
BINS = 4000  # of the histograms of scores from which the threshold is taken, over -10 to 10
BROADCAST_GRAMS = 4_000_000  # distinct grams (64 MB) that are broadcast to score with; more are joined, with the same result

#: Words that mark a host as a rejected seed, where they are a whole part of it between dots and hyphens. All other URLs are accepted seeds, unless seeds are given.
REJECTED = ("casino", "casinos", "bet", "bets", "betting", "poker", "slots", "adult", "porn", "xxx", "sex", "spam", "pill", "pills", "viagra", "ad", "ads", "adserver", "malware", "phish", "phishing", "warez", "torrent", "torrents")

PARTS = re.compile(r"[^.\-]+")


def host_of(url: str) -> str:
    return url.strip().split("://", 1)[-1].split("/", 1)[0].split("?", 1)[0].split("@")[-1].split(":", 1)[0].lower()


def is_rejected(host: str) -> bool:
    return not set(PARTS.findall(host)).isdisjoint(REJECTED)


def usable(url: str | None) -> bytes | None:
    """A URL's bytes without scheme, fragment and outer white space; None if nothing is left."""
    if url is None:
        return None
    bare = url.strip().split("://", 1)[-1].split("#", 1)[0]
    return bare.encode("utf-8", "replace") or None


def grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of every byte of every URL, and its end: the URL, and the gram: the ORDER bytes before it and it itself as the low byte, in one number."""
    raw = np.frombuffer(b"".join(b"\x02" * ORDER + u + b"\x03" for u in urls), np.uint8).astype(np.int64)
    sizes = np.array([len(u) + 1 for u in urls], np.int64)
    at = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(urls) + 1) * ORDER, sizes)
    gram = np.zeros(len(at), np.int64)
    for n in range(ORDER, -1, -1):
        gram = (gram << 8) | raw[at - n]
    return np.repeat(np.arange(len(urls)), sizes), gram


def portions(urls: list[bytes], most: int = 500_000):
    """Runs of URLs of about so many bytes together."""
    part, held = [], 0
    for k, u in enumerate(urls):
        part.append(k)
        held += len(u)
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def counts(urls: DataFrame) -> DataFrame:
    """(gram, a0, r0, a1, r1): how often each gram occurs in the accepted and rejected URLs of either fold. Exact, however many there are."""

    def read(source):
        for batch in source:
            raw = [usable(u) for u in batch.column("url").to_pylist()]
            model = batch.column("fold").to_numpy(zero_copy_only=False) * 2 + batch.column("rejected").to_numpy(zero_copy_only=False)
            for part in portions(raw):
                of, gram = grams([raw[k] for k in part])
                one, at = np.unique(gram, return_inverse=True)
                n = np.bincount(at * 4 + model[part].astype(np.int64)[of], minlength=4 * len(one)).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(one), *(pa.array(n[:, k]) for k in range(4))], names=["gram", *MODELS])

    rows = urls.select("url", "fold", "rejected").mapInArrow(read, "gram long, a0 long, r0 long, a1 long, r1 long")
    return rows.groupBy("gram").agg(*[F.sum(c).alias(c) for c in MODELS])


MODELS = ("a0", "r0", "a1", "r1")


def narrowed(p: np.ndarray, n: np.ndarray, gram: np.ndarray, order: int) -> np.ndarray:
    """Probabilities (rows, models) of the grams' last bytes after their last `order` bytes, smoothed by those after one byte less."""
    total, pair = (np.unique((gram >> 8 * shift) & ((1 << 8 * (order + 1 - shift)) - 1), return_inverse=True)[1] for shift in (1, 0))
    out = np.empty_like(p)
    for k in range(p.shape[1]):
        out[:, k] = (np.bincount(pair, n[:, k])[pair] + MASS * p[:, k]) / (np.bincount(total, n[:, k])[total] + MASS)
    return out


def gaps(found: DataFrame) -> DataFrame:
    """(gram, g0, g1): log-probability of the gram's last byte after the others under the accepted model less that under the rejected one, in units of 1 / SCALE. A URL of fold 0 is scored by g0, which is learnt from fold 1, and the other way round.

    The distribution after each context is smoothed by that after one byte less, down to the uniform one. Contexts up to one byte are common to all, at most 65,536 grams, and broadcast; grams that share the two bytes before the last share all longer contexts and are worked on together.
    """
    short = found.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(*[F.sum(c).alias(c) for c in MODELS]).toPandas().sort_values("gram")
    pairs, n = short["gram"].to_numpy(np.int64), short[list(MODELS)].to_numpy(np.float64)
    p = np.full(n.shape, 1.0 / ALPHABET)
    for order in (0, 1):
        p = narrowed(p, n, pairs, order)
    shared = found.sparkSession.sparkContext.broadcast((pairs, p))

    def longer(rows: pa.Table) -> pa.Table:
        pairs, p_short = shared.value
        gram = rows.column("gram").to_numpy()
        n = np.stack([rows.column(c).to_numpy() for c in MODELS], axis=1).astype(np.float64)
        p = p_short[np.searchsorted(pairs, gram & 0xFFFF)]
        for order in range(2, ORDER + 1):
            p = narrowed(p, n, gram, order)
        logs = np.log(p)
        g = [np.rint((logs[:, k] - logs[:, k + 1]) * SCALE).astype(np.int64) for k in (2, 0)]
        return pa.table({"gram": gram, "g0": g[0], "g1": g[1]})

    return found.groupBy(F.shiftright("gram", 8).bitwiseAND(0xFFFF)).applyInArrow(longer, "gram long, g0 long, g1 long")


def scores(urls: DataFrame, gap: DataFrame) -> DataFrame:
    """(id, score): the mean gap of each URL's bytes, rounded to 6 places."""
    spark = urls.sparkSession
    if gap.count() <= BROADCAST_GRAMS:
        held = gap.orderBy("gram").toPandas()
        shared = spark.sparkContext.broadcast((held["gram"].to_numpy(np.int64), held[["g0", "g1"]].to_numpy(np.int64)))

        def summed(source):
            gram, g = shared.value
            for batch in source:
                raw, fold, ids = [usable(u) for u in batch.column("url").to_pylist()], batch.column("fold").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False)
                for part in portions(raw):
                    of, own = grams([raw[k] for k in part])
                    total = np.zeros(len(part), np.int64)
                    np.add.at(total, of, g[np.searchsorted(gram, own), fold[part][of]])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(total), pa.array(np.bincount(of, minlength=len(part)))], names=["id", "total", "n"])

        sums = urls.select("id", "url", "fold").mapInArrow(summed, "id long, total long, n long")
    else:

        def spread(source):
            for batch in source:
                raw, ids = [usable(u) for u in batch.column("url").to_pylist()], batch.column("id").to_numpy(zero_copy_only=False)
                fold = batch.column("fold").to_numpy(zero_copy_only=False)
                for part in portions(raw):
                    of, gram = grams([raw[k] for k in part])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part][of]), pa.array(fold[part][of], pa.int32()), pa.array(gram)], names=["id", "fold", "of"])

        rows = urls.select("id", "url", "fold").mapInArrow(spread, "id long, fold int, of long")
        joined = rows.join(gap, rows["of"] == gap["gram"])
        sums = joined.groupBy("id").agg(F.sum(F.when(F.col("fold") == 0, F.col("g0")).otherwise(F.col("g1"))).alias("total"), F.count("*").alias("n"))
    return sums.select("id", F.round(F.col("total") / F.col("n") / SCALE, 6).alias("score"))


def threshold(rows: DataFrame) -> float:
    """The score at which the shares of accepted seeds below it and of rejected seeds from it on have the least sum, to 1 / 200; the lowest of several. Where a kind has no seed, no score is below it."""
    bins = rows.groupBy(F.floor((F.greatest(F.lit(-10.0), F.least(F.lit(9.999), F.col("score"))) + 10) * (BINS / 20)).cast("int").alias("bin"), "rejected").agg(F.count("*").alias("n")).collect()
    n = np.zeros((2, BINS + 1))
    for r in bins:
        n[int(r["rejected"]), r["bin"] + 1] += r["n"]
    total = n.sum(axis=1)
    if not total.all():
        return -11.0
    below = np.cumsum(n, axis=1) / total[:, None]
    return float(np.argmin(below[0] + 1 - below[1])) * 20 / BINS - 10


def filtered(pages: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(page_id, url, rejected_seed, score, keep) of every page.

    Two smoothed variable-order Markov models over bytes are counted from all distinct URLs: one from the rejected seeds, one from the accepted ones. `seeds` (url, rejected) says which are which; URLs that aren't in it, or all if there is none, are rejected seeds if a part of their host is a word of REJECTED, else accepted ones. The score is the difference of a URL's log-likelihoods by byte. URLs are in two folds by their hash and each is scored by the models of the other fold, so nothing of a URL or its repeats is in the models that judge it. The threshold balances the shares of seeds of both kinds that are on the wrong side; any share of the pages may be below it. A URL is kept if its score isn't.

    Counts are exact and as many as the distinct grams of the corpus; they are broadcast only up to BROADCAST_GRAMS and joined beyond, with the same result. Null and empty URLs have no score and aren't kept; an empty table gives an empty one; where a kind has no seed every URL with a score is kept. Very long URLs are scored whole; repeated rows get a row each, with equal scores, and count once; ties are kept or rejected together; a null page_id is passed on; other columns, of any name, are ignored.
    """
    known = batches(pages.select("url").where("url is not null").distinct(), lambda b: _seeded(b.column(0).to_pylist()), "url string, rejected boolean")
    if seeds is not None:
        told = seeds.where("url is not null and rejected is not null").groupBy("url").agg(F.max("rejected").alias("told")).withColumnRenamed("url", "of")
        known = known.join(told, known["url"] == told["of"], "left").select("url", F.coalesce("told", "rejected").alias("rejected"))
    fold: Column = F.pmod(F.xxhash64("url"), F.lit(2)).cast("int")
    urls = written(known.select("url", "rejected", fold.alias("fold"), F.monotonically_increasing_id().alias("id")), "urls")
    gap = written(gaps(written(counts(urls), "grams")), "gaps")
    judged = written(urls.join(scores(urls, gap), "id").select(F.col("url").alias("of"), "rejected", "score"), "scores")
    dropped(gap, urls)
    limit = threshold(judged)
    rows = pages.select("page_id", "url").join(judged, F.col("url") == F.col("of"), "left")
    return rows.select("page_id", "url", F.coalesce("rejected", F.when(F.col("url").isNotNull(), F.lit(False))).alias("rejected_seed"), "score", F.coalesce(F.col("score") >= F.lit(limit), F.lit(False)).alias("keep"))


def _seeded(urls: list[str]) -> dict:
    some = [u for u in urls if usable(u) is not None]
    return {"url": some, "rejected": [is_rejected(host_of(u)) for u in some]}


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"))
