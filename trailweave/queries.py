"""The path queries that are registered by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import table_graph
from .operators.frontier import FrontierEvaluator
from .operators.relational import RelationalEvaluator
from .plans.ast import PathQuery, labels
from .sparql import parse_query

BASE = "http://tables.test/"

EDGES = {
    "placed_by": "SELECT DISTINCT 'orders/' || o_orderkey AS s, 'customer/' || o_custkey AS t FROM orders",
    "in_nation": "SELECT DISTINCT 'customer/' || c_custkey AS s, 'nation/' || c_nationkey AS t FROM customer UNION SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier",
    "in_region": "SELECT DISTINCT 'nation/' || n_nationkey AS s, 'region/' || n_regionkey AS t FROM nation",
    "contains": "SELECT DISTINCT 'orders/' || l_orderkey AS s, 'part/' || l_partkey AS t FROM lineitem",
    "supplied_by": "SELECT DISTINCT 'part/' || l_partkey AS s, 'supplier/' || l_suppkey AS t FROM lineitem",
    "reply": "SELECT * FROM (SELECT 'conversations/' || conv_id || '/' || turn AS s, 'conversations/' || conv_id || '/' || LEAD(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE t IS NOT NULL",
    "next": "SELECT * FROM (SELECT 'events/' || event_id AS s, 'events/' || LEAD(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) WHERE t IS NOT NULL",
    "top_partner": "SELECT 'nation/' || s_nationkey AS s, 'nation/' || c_nationkey AS t FROM (SELECT s_nationkey, c_nationkey, ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY COUNT(*) DESC, c_nationkey) AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY s_nationkey, c_nationkey) WHERE r = 1",
}

SEQ2 = "SELECT a.s, b.t FROM placed_by a JOIN in_nation b ON a.t = b.s"
SEQ3 = "SELECT a.s, c.t FROM placed_by a JOIN in_nation b ON a.t = b.s JOIN in_region c ON b.t = c.s"
SUPPLY = "SELECT a.s, c.t FROM contains a JOIN supplied_by b ON a.t = b.s JOIN in_nation c ON b.t = c.s"


def plus(label: str, where: str = "") -> str:
    return f"SELECT s, t FROM {label} {where} UNION SELECT p.s, e.t FROM p JOIN {label} e ON p.t = e.s"


#: Path: (pattern, SQL over tables of the labels, with `p` for its recursive part and `v` for the vertices).
PATHS: dict[str, tuple[str, str, str]] = {
    "label_scan": ("?x <in_region> ?y", "", "SELECT s, t FROM in_region"),
    "seq2": ("?x <placed_by>/<in_nation> ?y", "", SEQ2),
    "seq3": ("?x <placed_by>/<in_nation>/<in_region> ?y", "", SEQ3),
    "alt": ("?x <placed_by>|<contains> ?y", "", "SELECT s, t FROM placed_by UNION SELECT s, t FROM contains"),
    "alt_seq": ("?x (<placed_by>/<in_nation>)|(<contains>/(<supplied_by>/<in_nation>)) ?y", "", f"{SEQ2} UNION {SUPPLY}"),
    "opt": ("?x <in_region>? ?y", "", "SELECT s, t FROM in_region UNION SELECT n, n FROM v"),
    "opt_seq": ("?x <placed_by>/<in_nation>? ?y", "", f"SELECT s, t FROM placed_by UNION {SEQ2}"),
    "plus_acyclic": ("?x <reply>+ ?y", plus("reply"), "SELECT s, t FROM p"),
    "star_acyclic": ("?x <reply>* ?y", plus("reply"), "SELECT s, t FROM p UNION SELECT n, n FROM v"),
    "plus_cyclic": ("?x <top_partner>+ ?y", plus("top_partner"), "SELECT s, t FROM p"),
    "star_cyclic": ("?x <top_partner>* ?y", plus("top_partner"), "SELECT s, t FROM p UNION SELECT n, n FROM v"),
    "plus_deep": ("?x <next>+ ?y", plus("next"), "SELECT s, t FROM p"),
    "star_mid": ("?x <placed_by>/<in_nation>/<top_partner>*/<in_region> ?y", plus("top_partner"), f"SELECT x.s, r.t FROM ({SEQ2}) x JOIN (SELECT s, t FROM p UNION SELECT n, n FROM v) y ON x.t = y.s JOIN in_region r ON y.t = r.s"),
    "nested_star": ("?x ((<top_partner>|<in_region>)+)* ?y", "SELECT s, t FROM (SELECT * FROM top_partner UNION SELECT * FROM in_region) UNION SELECT p.s, e.t FROM p JOIN (SELECT * FROM top_partner UNION SELECT * FROM in_region) e ON p.t = e.s", "SELECT s, t FROM p UNION SELECT n, n FROM v"),
    "named_subject": ("<customer/1> <in_nation>/<in_region> ?y", "", "SELECT a.s, b.t FROM in_nation a JOIN in_region b ON a.t = b.s WHERE a.s = 'customer/1'"),
    "named_object": ("?x <placed_by>/<in_nation> <nation/3>", "", f"SELECT * FROM ({SEQ2}) WHERE t = 'nation/3'"),
    "named_both": ("<customer/1> <in_nation>/<in_region>? <region/1>", "", "SELECT * FROM (SELECT s, t FROM in_nation UNION SELECT a.s, b.t FROM in_nation a JOIN in_region b ON a.t = b.s) WHERE s = 'customer/1' AND t = 'region/1'"),
    "named_both_hit": ("<customer/1> <in_nation>/<in_region>? <region/4>", "", "SELECT * FROM (SELECT s, t FROM in_nation UNION SELECT a.s, b.t FROM in_nation a JOIN in_region b ON a.t = b.s) WHERE s = 'customer/1' AND t = 'region/4'"),
    "named_both_star": ("<customer/1> <in_nation>/<top_partner>*/<in_region>? <nation/19>", plus("top_partner"), "SELECT DISTINCT a.s, y.t FROM in_nation a JOIN (SELECT s, t FROM p UNION SELECT n, n FROM v) y ON a.t = y.s WHERE a.s = 'customer/1' AND y.t = 'nation/19'"),
    "named_plus": ("<events/1> <next>+ ?y", plus("next", "WHERE s = 'events/1'"), "SELECT s, t FROM p"),
    "named_plus_object": ("?x <next>+ <events/500>", "SELECT s, t FROM next WHERE t = 'events/500' UNION SELECT e.s, p.t FROM p JOIN next e ON p.s = e.t", "SELECT s, t FROM p"),
    "named_star": ("<nation/3> <top_partner>* ?y", plus("top_partner", "WHERE s = 'nation/3'"), "SELECT s, t FROM p UNION SELECT n, n FROM v WHERE n = 'nation/3'"),
}

#: Run by rounds of joins too, as beyond the limit of what is searched within tasks.
ROUNDS = ["plus_cyclic", "plus_acyclic", "plus_deep", "star_mid", "named_star", "named_plus_object"]
TARGET_ROUNDS = ["star_mid", "plus_deep", "seq3", "named_star"]

COUNTED = ["seq3", "alt_seq", "plus_acyclic", "star_cyclic", "star_mid", "named_subject"]


def parsed(name: str) -> PathQuery:
    return parse_query(f"BASE <{BASE}> SELECT * WHERE {{ {PATHS[name][0]} }}").strip_base(BASE)


def _graph(spark: SparkSession, sf_dir: str, query: PathQuery):
    return table_graph(spark, sf_dir, dict.fromkeys(labels(query.path)))


def pairs(name: str, local_pairs: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = parsed(name)
        return RelationalEvaluator(optional=True, local_pairs=local_pairs).evaluate(query, _graph(spark, sf_dir, query)).named()

    return run


def targets(name: str, local_pairs: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = parsed(name)
        return FrontierEvaluator(local_pairs).evaluate(query, _graph(spark, sf_dir, query)).named()

    return run


def counted(name: str, what: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = parsed(name)
        found = RelationalEvaluator(optional=True).evaluate(query, _graph(spark, sf_dir, query))
        return (found.rows if what == "nnz" else found.targets).agg(F.count("*").alias(what))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries that run a closure start jobs while they are built."""
    out = {name: pairs(name) for name in PATHS}
    out |= {f"targets_{name}": targets(name) for name in PATHS}
    out |= {f"{name}_rounds": pairs(name, 0) for name in ROUNDS}
    out |= {f"targets_{name}_rounds": targets(name, 0) for name in TARGET_ROUNDS}
    out |= {f"nnz_{name}": counted(name, "nnz") for name in COUNTED}
    return out | {f"target_count_{name}": counted(name, "target_count") for name in COUNTED}


def _sql(name: str, select: str) -> str:
    _, recursive, body = PATHS[name]
    used = list(dict.fromkeys(labels(parsed(name).path)))
    parts = [f"{label} AS ({EDGES[label]})" for label in used]
    parts.append("v AS (" + " UNION ".join(f"SELECT s AS n FROM {label} UNION SELECT t FROM {label}" for label in used) + ")")
    if recursive:
        parts.append(f"p AS ({recursive})")
    parts.append(f"found(source, target) AS ({body})")
    return f"WITH RECURSIVE {', '.join(parts)} {select}"


def oracle_sql() -> dict[str, str]:
    out = {name: _sql(name, "SELECT DISTINCT source, target FROM found") for name in PATHS}
    out |= {f"targets_{name}": _sql(name, "SELECT DISTINCT target FROM found") for name in PATHS}
    out |= {f"{name}_rounds": out[name] for name in ROUNDS}
    out |= {f"targets_{name}_rounds": out[f"targets_{name}"] for name in TARGET_ROUNDS}
    out |= {f"nnz_{name}": _sql(name, "SELECT COUNT(*) AS nnz FROM (SELECT DISTINCT source, target FROM found)") for name in COUNTED}
    return out | {f"target_count_{name}": _sql(name, "SELECT COUNT(DISTINCT target) AS target_count FROM found") for name in COUNTED}
