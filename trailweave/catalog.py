"""Edge-labelled graphs from the TPC-H-like tables. Nodes are named table/key; ids are computed from keys, so no dictionary is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import PathGraph
from .storage import FEW_PARTS, partitions

KINDS = ["", "orders", "customer", "nation", "supplier", "region", "part", "conversations", "events"]
TURNS = 1 << 20


def node(kind: str, key: Column) -> Column:
    return key.cast("long") * len(KINDS) + KINDS.index(kind)


def named(id_: Column) -> Column:
    key = F.floor(id_ / F.lit(len(KINDS)))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (id_ % len(KINDS) + 1).cast("int"))
    turn = F.concat(F.floor(key / F.lit(TURNS)).cast("string"), F.lit("/"), (key % TURNS).cast("string"))
    return F.concat(kind, F.lit("/"), F.when(kind == "conversations", turn).otherwise(key.cast("string")))


def numbered(name: str) -> int | None:
    kind, *keys = name.split("/")
    if kind not in KINDS[1:] or not all(k.isdigit() for k in keys) or len(keys) != (2 if kind == "conversations" else 1):
        return None
    key = int(keys[0]) * TURNS + int(keys[1]) if kind == "conversations" else int(keys[0])
    return key * len(KINDS) + KINDS.index(kind)


def label_table(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """(src, dst) of one label; repeats are left in."""

    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def edges(df: DataFrame, a: Column, b: Column) -> DataFrame:
        return df.select(a.alias("src"), b.alias("dst")).where("src is not null and dst is not null")

    match label:
        case "placed_by":
            return edges(t("orders"), node("orders", F.col("o_orderkey")), node("customer", F.col("o_custkey")))
        case "in_nation":
            a = edges(t("customer"), node("customer", F.col("c_custkey")), node("nation", F.col("c_nationkey")))
            return a.union(edges(t("supplier"), node("supplier", F.col("s_suppkey")), node("nation", F.col("s_nationkey"))))
        case "in_region":
            return edges(t("nation"), node("nation", F.col("n_nationkey")), node("region", F.col("n_regionkey")))
        case "contains":
            return edges(t("lineitem"), node("orders", F.col("l_orderkey")), node("part", F.col("l_partkey")))
        case "supplied_by":
            return edges(t("lineitem"), node("part", F.col("l_partkey")), node("supplier", F.col("l_suppkey")))
        case "reply":
            order = Window.partitionBy("conv_id").orderBy("turn")
            turns = t("conversations").select("conv_id", "turn").distinct().withColumn("after", F.lead("turn").over(order))
            key = lambda c: F.col("conv_id") * TURNS + F.col(c)
            return edges(turns, node("conversations", key("turn")), node("conversations", key("after")))
        case "next":
            order = Window.partitionBy("user_id").orderBy("ts", "event_id")
            events = t("events").select("user_id", "ts", "event_id").withColumn("after", F.lead("event_id").over(order))
            return edges(events, node("events", F.col("event_id")), node("events", F.col("after")))
        case "top_partner":
            lines = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
            buyers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
            parts = partitions(lines, buyers)
            if parts > FEW_PARTS:  # so that a task sorts a bounded number of lines
                lines, buyers = lines.repartition(parts, "l_orderkey"), buyers.repartition(parts, "o_orderkey")
            trade = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
            best = Window.partitionBy("s_nationkey").orderBy(F.desc("n"), "c_nationkey")
            top = trade.withColumn("rank", F.row_number().over(best)).where("rank = 1")
            return edges(top, node("nation", F.col("s_nationkey")), node("nation", F.col("c_nationkey")))
    raise ValueError(label)


def table_graph(spark: SparkSession, sf_dir: str, labels: Iterable[str]) -> PathGraph:
    """The graph of some labels; its vertices are the ends of their edges. Nothing runs until a query does: a label that a query leaves out is never read."""
    labels = list(labels)
    edges: DataFrame | None = None
    for label in labels:
        part = label_table(spark, sf_dir, label).select("src", F.lit(label).alias("label"), "dst")
        edges = part if edges is None else edges.union(part)
    ids = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return PathGraph(edges, ids.select("id", named(F.col("id")).alias("name")), named=named, known_labels=frozenset(labels), numbered=numbered, unique=False)
