"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hashable, table, unused, written

UNIT = 1_000_000  # one copy, in the fixed-point unit of the prefix sums
SEED = 42


def expected(docs: DataFrame, weights: dict[str, int] | None = None, total_chars: int | None = None) -> DataFrame:
    """Per source: `unit`, the expected copies of each of its documents in millionths, and the random `start` offset.

    `weights` gives whole-number target weights by source (a source without one gets none of the mix); by default a source weighs the square root of its characters. `total_chars` is the size of the mix, by default that of the corpus. The table has one row a source.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("chars"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.expr("cast(floor(sqrt(cast(chars as double))) as bigint)"))
    else:
        pairs = docs.sparkSession.createDataFrame(list(weights.items()), "wanted string, weight bigint")
        weighed = sizes.join(pairs, sizes["source"].eqNullSafe(pairs["wanted"]), "left").select("source", "chars", F.coalesce("weight", F.lit(0)).cast("bigint").alias("weight"))
    whole = weighed.agg(F.sum("weight").cast("decimal(38,0)").alias("all_weight"), F.sum("chars").alias("all_chars"))
    size = "all_chars" if total_chars is None else str(int(total_chars))
    return weighed.crossJoin(whole).select(
        F.col("source").alias("of_source"),
        F.expr(
            f"case when chars = 0 or all_weight = 0 then 0L else cast((cast({size} as decimal(17,0)) * cast(weight as decimal(11,0)) * cast({UNIT} as decimal(8,0)))"
            " div (cast(all_weight as decimal(16,0)) * cast(chars as decimal(17,0))) as bigint) end"
        ).alias("unit"),
        F.expr(f"cast(conv(substr(md5(concat('{SEED}:', coalesce(source, ''))), 1, 8), 16, 10) as bigint) % {UNIT}").alias("start"),
    )


def text_hash() -> Column:
    return F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")


def mix_sources(docs: DataFrame, weights: dict[str, int] | None = None, total_chars: int | None = None) -> DataFrame:
    """The mix as (doc_id, source, copy), a row for each copy that is taken, copies of a document counting from 1.

    Within a source, documents in the order of doc_id (then of text hash, so ties have a defined order) hold consecutive stretches of a line, each as long as its expected copies; a copy is emitted for each whole number crossed after a random start. A document's copies are thus its expected number rounded down or up, and a source's total is within one of its target. Null sources form a source of their own; null and empty texts count no characters but are sampled as others are; a source without characters or weight yields nothing; repeated doc_ids and repeated rows are sampled separately; very long texts count all their characters; an empty table gives an empty mix; other columns, of any name, are ignored.

    The prefix sum is done in two levels over ranges of (source, doc_id), so a hot source is spread over many tasks: sums within a range, plus the sums of the ranges before it. Only those narrow rows are shuffled, never texts. The ranges are written once, so a task run again sees the same ones.
    """
    copies = picks(docs.select("doc_id", "source", text_hash()), expected(docs, weights, total_chars), ["h"])
    return copies.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def picks(narrow: DataFrame, rates: DataFrame, ties: list[str]) -> DataFrame:
    """The rows of which a copy is taken, with their number of copies. `narrow` has doc_id, source and the columns that order rows of one doc_id."""
    order = ["doc_id", *ties]
    ranged = written(narrow.repartitionByRange("source", *order).withColumn("part", F.spark_partition_id()), "mix")
    counts = ranged.groupBy("source", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("o_source"), F.col("part").alias("o_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "part").orderBy(*order)
    placed = ranged.withColumn("rank", F.row_number().over(within))
    line = placed.join(offsets, placed["source"].eqNullSafe(offsets["o_source"]) & (placed["part"] == offsets["o_part"])).join(rates, placed["source"].eqNullSafe(rates["of_source"]))
    line = line.withColumn("finish", F.expr("start + (before + rank) * unit"))
    return line.select(*narrow.columns, F.expr(f"cast(finish div {UNIT} - (finish - unit) div {UNIT} as int)").alias("copies")).where("copies > 0")


def training_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with all their columns, a row for each copy, and its number as `copy` (`copy_`, and so on, if the documents have a column of that name).

    Documents of one doc_id are ordered by the hashes of their text and of all their columns; rows that are equal in all columns are sampled separately and the copies of all of them have the same columns. Null and empty texts, null sources, very long texts, ties and an empty table as in `mix_sources`; other columns may have any name. Texts are shuffled once.
    """
    g, g2 = (F.xxhash64(*hashable(docs)).alias("g"), F.hash(*hashable(docs)).alias("g2"))
    taken = picks(docs.select("doc_id", "source", text_hash(), g, g2), expected(docs), ["h", "g", "g2"])
    taken = taken.groupBy(F.col("g").alias("t_g"), F.col("g2").alias("t_g2")).agg(F.flatten(F.collect_list(F.sequence(F.lit(1), F.col("copies")))).alias("t_copies"))
    one, two, row, copy = (unused(docs, n) for n in ("g", "g2", "row", "copy"))
    marked = docs.withColumns({one: F.xxhash64(*hashable(docs)), two: F.hash(*hashable(docs))})
    whole = marked.join(taken, (marked[one] == taken["t_g"]) & (marked[two] == taken["t_g2"]))
    first = whole.withColumn(row, F.row_number().over(Window.partitionBy(one, two).orderBy(one))).where(F.col(row) == 1)
    return first.select(*[first[c] for c in docs.columns], F.explode("t_copies").alias(copy))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH sizes AS (SELECT source, SUM(COALESCE(LENGTH(text), 0))::BIGINT AS chars FROM documents GROUP BY source),
weighed AS (SELECT source, chars, FLOOR(SQRT(chars::DOUBLE))::BIGINT AS weight FROM sizes),
rates AS (
  SELECT source, ('0x' || SUBSTR(MD5('{SEED}:' || COALESCE(source, '')), 1, 8))::BIGINT % {UNIT} AS start,
         CASE WHEN chars = 0 THEN 0 ELSE ((SELECT SUM(chars) FROM weighed)::HUGEINT * weight * {UNIT}) // ((SELECT SUM(weight) FROM weighed)::HUGEINT * chars) END::BIGINT AS unit
  FROM weighed),
line AS (
  SELECT d.doc_id, d.source, r.unit, r.start + r.unit * ROW_NUMBER() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS finish
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
copies AS (SELECT doc_id, source, (finish // {UNIT} - (finish - unit) // {UNIT})::INT AS copies FROM line)
SELECT doc_id, source, UNNEST(RANGE(1, copies + 1))::INT AS copy FROM copies WHERE copies > 0
"""
