"""Queries that go through the sources: the tables' edges are written in a format to the shared folder, loaded again and queried, with the same SQL as the direct queries."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import table_graph
from .cli.checkpoint import Checkpoint
from .cli.output import write_json
from .cli.run import bench_queries, run_queries
from .errors import TrailError
from .graph import PathGraph
from .operators.frontier import FrontierEvaluator
from .operators.relational import RelationalEvaluator
from .plans.ast import labels
from .queries import BASE, PATHS, _sql, parsed
from .sources.csv_edges import read_csv
from .sources.matrix_market import read_matrix_market, triples
from .sources.query_file import load_queries
from .sources.rdf import left_out, read_rdf
from .sparql import parse_query
from .storage import shared_dir, written

PATH_QUERIES = ["seq3", "plus_cyclic", "star_mid", "named_both_hit"]
GRAPH_LABELS = ["placed_by", "in_nation", "in_region", "top_partner"]


def exported(spark: SparkSession, sf_dir: str, wanted: list[str]) -> DataFrame:
    """(source, label, target) names of some labels' edges."""
    graph = table_graph(spark, sf_dir, wanted)
    return graph.with_names(graph.edges.distinct().select(F.col("src").alias("source"), "label", F.col("dst").alias("target")), "source", "target")


def folder(spark: SparkSession, what: str) -> str:
    return os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")


def put_text(spark: SparkSession, path: str, lines: list[str]) -> None:
    """A small text file, wherever Spark's file systems reach."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray("\n".join(lines) + "\n", "utf-8"))
    out.close()


def csv_graph(spark: SparkSession, sf_dir: str, wanted: list[str]) -> PathGraph:
    path = folder(spark, "csv")
    exported(spark, sf_dir, wanted).select("source", "target", "label").write.option("header", True).csv(path)
    return PathGraph.from_triples(read_csv(spark, path))


def csv_named_graph(spark: SparkSession, sf_dir: str, wanted: list[str]) -> PathGraph:
    """Other columns, found by name, and another delimiter."""
    path = folder(spark, "csv")
    exported(spark, sf_dir, wanted).select(F.lit(1).alias("weight"), F.col("label").alias("rel"), F.col("target").alias("to"), F.col("source").alias("from")).write.option("header", True).option("sep", "\t").csv(path)
    return PathGraph.from_triples(read_csv(spark, path, "from", "to", "rel", delimiter="\t"))


def csv_bare_graph(spark: SparkSession, sf_dir: str, wanted: list[str]) -> PathGraph:
    """Columns by place, without a header."""
    path = folder(spark, "csv")
    exported(spark, sf_dir, wanted).select("label", "source", "target").write.option("header", False).csv(path)
    return PathGraph.from_triples(read_csv(spark, path, 1, 2, 0, header=False))


def iri(name: str) -> Column:
    return F.concat(F.lit(f"<{BASE}"), F.col(name), F.lit(">"))


def ntriples_folder(spark: SparkSession, sf_dir: str, wanted: list[str]) -> str:
    """Edges, a comment, a literal for each nation and a faulty line for each region."""
    path = folder(spark, "nt")
    edges = exported(spark, sf_dir, wanted).select(F.concat_ws(" ", iri("source"), iri("label"), iri("target"), F.lit(".")).alias("value"))
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit(f"<{BASE}nation/"), F.col("n_nationkey"), F.lit(f'> <{BASE}name> "'), F.col("n_name"), F.lit('"@en . # name')))
    faults = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("no triple "), F.col("r_regionkey")))
    edges.union(names).union(faults).union(spark.range(1).select(F.lit("# a comment"))).write.text(path)
    return path


def local(rows: DataFrame) -> DataFrame:
    """Names without the base."""
    return rows.select(*(F.regexp_replace(c, f"^{BASE}", "").alias(c) for c in rows.columns))


def ntriples_graph(spark: SparkSession, sf_dir: str, wanted: list[str]) -> PathGraph:
    return PathGraph.from_triples(local(read_rdf(spark, ntriples_folder(spark, sf_dir, wanted), "ntriples")))


def turtle_graph(spark: SparkSession, sf_dir: str, wanted: list[str]) -> PathGraph:
    """Several files, each with its own prefixes, object lists and comments."""
    path = folder(spark, "ttl")
    rows = exported(spark, sf_dir, wanted).groupBy("source", "label").agg(F.concat_ws(" , ", F.collect_list(F.concat(F.lit("<"), F.col("target"), F.lit(">")))).alias("targets"))
    lines = rows.select(F.concat(F.lit("<"), F.col("source"), F.lit("> t:"), F.col("label"), F.lit(" "), F.col("targets"), F.lit(" .")).alias("value"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([f"@prefix t: <{BASE}> .", f"@base <{BASE}> . # of this file"])], names=["value"])
        yield from batches

    lines.mapInArrow(headed, "value string").write.text(path)
    return PathGraph.from_triples(local(read_rdf(spark, path, "turtle")))


def matrix_folder(spark: SparkSession, sf_dir: str, wanted: list[str]) -> str:
    path = folder(spark, "mm")
    edges = written(exported(spark, sf_dir, wanted), "edges")
    names = edges.select(F.col("source").alias("name")).union(edges.select("target")).distinct()
    vertices = written(names.select("name", (F.monotonically_increasing_id() + 1).alias("index")), "vertices")
    vertices.select(F.concat(F.lit("<"), F.col("name"), F.lit("> "), F.col("index"))).write.text(f"{path}/vertices.txt")
    put_text(spark, f"{path}/edges.txt", [f"<{label}> {k}" for k, label in enumerate(wanted, 1)])
    most = vertices.agg(F.max("index")).first()[0] or 0
    a, b = (vertices.select(F.col("name").alias(c), F.col("index").alias(i)) for c, i in (("source", "row"), ("target", "column")))
    cells = edges.join(a, "source").join(b, "target")
    for k, label in enumerate(wanted, 1):  # a folder of files, of which the first by name has the header
        own = cells.where(F.col("label") == label)
        own.select(F.concat_ws(" ", "row", "column").alias("value")).write.text(f"{path}/{k}.txt")
        head = ["%%MatrixMarket matrix coordinate pattern general", "% " + label, f"{most} {most} {edges.where(F.col('label') == label).count()}"]
        put_text(spark, f"{path}/{k}.txt/head.txt", head)
    return path


def matrix_graph(spark: SparkSession, sf_dir: str, wanted: list[str]) -> PathGraph:
    return read_matrix_market(spark, matrix_folder(spark, sf_dir, wanted))


def matrix_based_graph(spark: SparkSession, sf_dir: str, wanted: list[str]) -> PathGraph:
    """Names with a base IRI, merged by name into a graph of its own ids, without the base."""
    return PathGraph.from_triples(local(triples(read_matrix_market(spark, matrix_folder(spark, sf_dir, wanted), BASE))))


def tuples_graph(spark: SparkSession, sf_dir: str, wanted: list[str]) -> PathGraph:
    """From tuples on the driver: for small labels."""
    return PathGraph.from_edges(spark, [(r["source"], r["target"], r["label"]) for r in exported(spark, sf_dir, wanted).collect()])


def merged_graph(spark: SparkSession, sf_dir: str, wanted: list[str]) -> PathGraph:
    """Each label from a source of another kind, with one label twice."""
    kinds = [csv_graph, ntriples_graph, matrix_graph, turtle_graph]
    parts = [triples(kinds[k % len(kinds)](spark, sf_dir, [label])) for k, label in enumerate(wanted)]
    return PathGraph.from_sources(*parts, exported(spark, sf_dir, wanted[:1]))


SOURCES: dict[str, Callable[[SparkSession, str, list[str]], PathGraph]] = {
    "csv": csv_graph,
    "csv_named": csv_named_graph,
    "csv_bare": csv_bare_graph,
    "nt": ntriples_graph,
    "ttl": turtle_graph,
    "mm": matrix_graph,
    "mm_based": matrix_based_graph,
    "tuples": tuples_graph,
    "merged": merged_graph,
}
#: Which path queries run on which source: all of them on one of each format, one on its variants.
RUN = {name: PATH_QUERIES if name in ("csv", "nt", "ttl", "mm") else ["plus_cyclic"] if name == "tuples" else ["seq3"] for name in SOURCES}


def through(source: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = parsed(name)
        graph = SOURCES[source](spark, sf_dir, list(dict.fromkeys(labels(query.path))))
        return RelationalEvaluator(optional=True).evaluate(query, graph).named()

    return run


def targets_through(source: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = parsed(name)
        return FrontierEvaluator().evaluate(query, SOURCES[source](spark, sf_dir, list(dict.fromkeys(labels(query.path))))).named()

    return run


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(what, n): the vertices, labels and each label's edges of a checked graph with repeated input."""
    rows = exported(spark, sf_dir, GRAPH_LABELS)
    graph = PathGraph.from_sources(rows, rows).check()
    counts = [("vertices", graph.num_nodes()), ("labels", graph.num_labels()), *((label, graph.num_edges(label)) for label in sorted(graph.labels))]
    return spark.createDataFrame(counts, "what string, n long")


def graph_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, known): names looked up in a graph's dictionary and back."""
    graph = csv_graph(spark, sf_dir, ["in_region"])
    found = []
    for k in range(30):
        name = f"nation/{k}"
        node = graph.node_id(name)
        found.append((name, node is not None and graph.node_name(node) == name))
    return spark.createDataFrame(found, "name string, known boolean")


def graph_from_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One relation of ids as a graph, closed."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    pairs = nations.select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst"))
    vertices = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct().select("id", F.col("id").cast("string").alias("name"))
    query = parsed("label_scan")
    return RelationalEvaluator().evaluate(query, PathGraph.from_pairs(pairs, "in_region", vertices)).named()


def rdf_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, n): what a read of N-Triples leaves out."""
    counts = left_out(spark, ntriples_folder(spark, sf_dir, ["in_region"]), "ntriples")
    return spark.createDataFrame(sorted(counts.items()), "kind string, n long")


LISTED = ["seq3", "star_mid", "named_both_hit", "opt"]


def query_file(spark: SparkSession) -> str:
    """A file of patterns on the driver, one of them faulty."""
    path = os.path.join(shared_dir(spark).removeprefix("file://"), f"queries-{uuid.uuid4().hex}.txt")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("".join(f"{name}, {PATHS[name][0]}\n" for name in LISTED) + "\nfaulty,?x !<in_region> ?y\n")
    return path


def listed(spark: SparkSession, sf_dir: str):
    """The queries of a file, without their base, and the graph that they are about."""
    queries = load_queries(query_file(spark), BASE)
    queries = [q if isinstance(q.parsed, Exception) else type(q)(q.id, q.text, q.parsed.strip_base(BASE)) for q in queries]
    return queries, csv_graph(spark, sf_dir, GRAPH_LABELS)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, algorithm, status, result_count) of a results file."""
    with open(path, encoding="utf-8") as f:
        body = json.load(f)
    rows = [(r["query_id"], a, o["status"], o.get("result_count")) for r in body["results"] for a, o in r["algorithms"].items()]
    return spark.createDataFrame(rows, "query_id string, algorithm string, status string, result_count long")


def _json(spark: SparkSession) -> str:
    return os.path.join(os.path.dirname(query_file(spark)), f"results-{uuid.uuid4().hex}.json")


def query_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command `query` writes for a file of queries and both evaluators."""
    queries, graph = listed(spark, sf_dir)
    path = _json(spark)
    write_json(path, {"num_nodes": graph.num_nodes()}, run_queries(queries, ["nfarpq", "rpqmatrix"], graph))
    return outcomes(spark, path)


def bench_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command `bench` writes when it is resumed from a checkpoint that has the first evaluator's part."""
    queries, graph = listed(spark, sf_dir)
    path = _json(spark)
    args = SimpleNamespace(sample_size=1, warm_up=0, measurement=0, checkpoint=f"{path}.checkpoint", criterion_dir=f"{path}.samples")
    bench_queries(queries, ["nfarpq"], graph, args, Checkpoint("graph", "queries", ["nfarpq", "rpqmatrix"]))
    kept = Checkpoint.load(args.checkpoint)
    kept.validate("graph", "queries", ["rpqmatrix", "nfarpq"])
    write_json(path, {"num_nodes": graph.num_nodes()}, bench_queries(queries, ["nfarpq", "rpqmatrix"], graph, args, kept))
    return outcomes(spark, path)


def by_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by way of their ids on the driver."""
    query = parsed("star_mid")
    graph = csv_graph(spark, sf_dir, list(dict.fromkeys(labels(query.path))))
    ids = FrontierEvaluator().evaluate(query, graph).indices()
    return graph.with_names(spark.createDataFrame([(i,) for i in ids], "target long"), "target")


#: Queries that are refused: what an evaluator, or the parser, raises.
REFUSED = {
    "?x <in_region> ?y . ?x <in_region> ?z": "NotSinglePath",
    "?x ?p ?y": "VariablePredicate",
    "?x !<in_region> ?y": "UnsupportedPath",
    "?x <no_label> ?y": "LabelNotFound",
    "<nation/none> <in_region> ?y": "VertexNotFound",
    "?x <in_region>? ?y": "UnsupportedPath",
    "?x <in_region ?y": "SyntaxProblem",
}


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pattern, error) of queries that have no answer."""
    graph = csv_graph(spark, sf_dir, ["in_region"])
    rows = []
    for pattern in REFUSED:
        try:
            RelationalEvaluator().evaluate(parse_query(f"BASE <{BASE}> SELECT * WHERE {{ {pattern} }}").strip_base(BASE), graph)
            rows.append((pattern, "none"))
        except TrailError as e:
            rows.append((pattern, type(e).__name__))
    return spark.createDataFrame(rows, "pattern string, error string")


HEADER = "%%MatrixMarket matrix coordinate pattern general"

#: Faulty inputs: the format, the lines of its files, and what a load raises.
FAULTY: dict[str, tuple[str, dict[str, list[str]], str]] = {
    "csv: no such column": ("csv", {"": ["from,to,rel", "A,B,knows"]}, "MissingColumn"),
    "csv: short record": ("csv", {"": ["source,target,label", "A,B"]}, "failed"),
    "mm: index twice": ("mm", {"vertices.txt": ["A 1", "B 1"], "edges.txt": ["knows 1"], "1.txt": [HEADER, "2 2 0"]}, "InvalidFormat"),
    "mm: index 0": ("mm", {"vertices.txt": ["A 0"], "edges.txt": ["knows 1"], "1.txt": [HEADER, "1 1 0"]}, "InvalidFormat"),
    "mm: no header": ("mm", {"vertices.txt": ["A 1"], "edges.txt": ["knows 1"], "1.txt": ["1 1 1", "1 1"]}, "InvalidFormat"),
    "mm: entry out of bounds": ("mm", {"vertices.txt": ["A 1"], "edges.txt": ["knows 1"], "1.txt": [HEADER, "1 1 1", "1 2"]}, "InvalidFormat"),
    "mm: edge without a vertex": ("mm", {"vertices.txt": ["A 1"], "edges.txt": ["knows 1"], "1.txt": [HEADER, "2 2 1", "1 2"]}, "GraphLoadError"),
    "mm: no matrix": ("mm", {"vertices.txt": ["A 1"], "edges.txt": ["knows 1"]}, "FormatError"),
    "rdf: unknown suffix": ("rdf", {"": ["<a> <b> <c> ."]}, "GraphLoadError"),
    "nt: literal, strict": ("strict", {"": ['<http://e/a> <http://e/b> "c" .']}, "failed"),
}


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(input, error) of inputs that are refused."""
    rows = []
    for name, (form, files, _) in FAULTY.items():
        path = folder(spark, "faulty")
        for file, lines in files.items():
            put_text(spark, os.path.join(path, file) if file else path, lines)
        try:
            if form == "mm":
                read_matrix_market(spark, path)
            elif form == "csv":
                read_csv(spark, path, *(("a", "b", "c") if "column" in name else ())).collect()
            else:
                read_rdf(spark, path, "ntriples" if form == "strict" else None, strict=True).collect()
            rows.append((name, "none"))
        except TrailError as e:
            rows.append((name, type(e).__name__))
        except Exception:  # noqa: BLE001, what Spark raises when a task fails
            rows.append((name, "failed"))
    return spark.createDataFrame(rows, "input string, error string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f"src_{source}_{name}": through(source, name) for source, names in RUN.items() for name in names}
    out |= {f"src_{source}_targets_star_mid": targets_through(source, "star_mid") for source in ("csv", "mm")}
    return out | {"graph_counts": graph_counts, "graph_lookups": graph_lookups, "graph_from_pairs": graph_from_pairs, "rdf_left_out": rdf_left_out, "query_run": query_run, "bench_resumed": bench_resumed, "src_csv_indices": by_indices, "refused_queries": refused, "refused_inputs": faulty}


def oracle_sql() -> dict[str, str]:
    out = {f"src_{source}_{name}": _sql(name, "SELECT DISTINCT source, target FROM found") for source, names in RUN.items() for name in names}
    out |= {f"src_{source}_targets_star_mid": _sql("star_mid", "SELECT DISTINCT target FROM found") for source in ("csv", "mm")}
    edges = _sql("star_mid", "")  # the tables of all labels
    tables = edges[: edges.index(", v AS (")].replace("WITH RECURSIVE ", "")
    every = " UNION ALL ".join(f"SELECT '{label}' AS label, s, t FROM {label}" for label in GRAPH_LABELS)
    out["graph_counts"] = (
        f"WITH {tables}, e AS ({every}) SELECT 'vertices' AS what, COUNT(*) AS n FROM (SELECT s FROM e UNION SELECT t FROM e)"
        " UNION ALL SELECT 'labels', COUNT(DISTINCT label) FROM e UNION ALL SELECT label, COUNT(*) FROM (SELECT DISTINCT * FROM e) GROUP BY label"
    )
    values = lambda rows: ", ".join("('{}', '{}')".format(a.replace("'", "''"), b) for a, b in rows)
    out["src_csv_indices"] = _sql("star_mid", "SELECT DISTINCT target FROM found")
    out["refused_queries"] = f"SELECT * FROM (VALUES {values(REFUSED.items())}) r(pattern, error)"
    out["refused_inputs"] = f"SELECT * FROM (VALUES {values((k, v[2]) for k, v in FAULTY.items())}) r(input, error)"
    out["graph_lookups"] = "SELECT 'nation/' || k AS name, k IN (SELECT n_nationkey FROM nation) AS known FROM RANGE(30) r(k)"
    out["graph_from_pairs"] = "SELECT DISTINCT n_nationkey::VARCHAR AS source, (n_regionkey + 100)::VARCHAR AS target FROM nation"
    out["rdf_left_out"] = "SELECT 'literal' AS kind, COUNT(*) AS n FROM nation UNION ALL SELECT 'fault', COUNT(*) FROM region"

    def counted(name: str) -> str:
        """Distinct targets over the whole graph, whose vertices `opt` joins to themselves."""
        sql = _sql(name, "SELECT COUNT(DISTINCT target) AS n FROM found")
        return f"WITH {tables}, e AS ({every}) SELECT COUNT(*) FROM (SELECT s FROM e UNION SELECT t FROM e)" if name == "opt" else sql

    ran = " UNION ALL ".join(
        f"SELECT '{name}' AS query_id, '{a}' AS algorithm, " + ("'error' AS status, NULL::BIGINT AS result_count" if a == "rpqmatrix" and "?" in PATHS[name][0].replace("?x", "").replace("?y", "") else f"'ok' AS status, ({counted(name)}) AS result_count")
        for a in ("nfarpq", "rpqmatrix")
        for name in LISTED
    )
    out["query_run"] = f"{ran} UNION ALL SELECT 'faulty', 'nfarpq', 'error', NULL UNION ALL SELECT 'faulty', 'rpqmatrix', 'error', NULL"
    out["bench_resumed"] = f"SELECT * FROM ({out['query_run']}) WHERE algorithm = 'rpqmatrix'"
    return out
