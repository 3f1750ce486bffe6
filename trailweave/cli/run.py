"""Loading, single runs and timed runs."""

from __future__ import annotations

import json
import logging
import os
import statistics
import time
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from ..errors import BenchError, GraphLoadError, QueryError, TrailError
from ..graph import PathGraph
from ..operators.frontier import FrontierEvaluator
from ..operators.relational import RelationalEvaluator
from ..sources.csv_edges import read_csv
from ..sources.matrix_market import read_matrix_market
from ..sources.query_file import LoadedQuery
from ..sources.rdf import read_rdf
from .checkpoint import Checkpoint
from .output import Outcome, QueryResult, replace_json

log = logging.getLogger("trailweave")

ALGORITHMS = {"nfarpq": FrontierEvaluator, "rpqmatrix": RelationalEvaluator}


def load_graph(spark: SparkSession, path: str, form: str, base: str | None = None) -> PathGraph:
    """A graph from a MatrixMarket directory, a CSV file or an RDF file. The base IRI goes before MatrixMarket names only."""
    try:
        if form == "mm":
            return read_matrix_market(spark, path, base)
        rows = read_csv(spark, path) if form == "csv" else read_rdf(spark, path)
        return PathGraph.from_triples(rows)
    except TrailError:
        raise
    except Exception as e:
        raise GraphLoadError(f"can't load {path} as {form}: {e}") from e


def metadata(graph: PathGraph, args) -> dict:
    return {"timestamp": datetime.now(UTC).isoformat(), "graph_path": args.graph, "graph_format": args.format, "queries_file": args.queries, "base_iri": args.base_iri, "num_nodes": graph.num_nodes(), "num_labels": graph.num_labels()}


def run_once(query: LoadedQuery, algorithm: str, graph: PathGraph) -> Outcome:
    """Whatever fails, fails for this query and algorithm only."""
    if isinstance(query.parsed, Exception):
        return Outcome("error", str(query.parsed))
    try:
        return Outcome("ok", result_count=ALGORITHMS[algorithm]().evaluate(query.parsed, graph).result_count)
    except QueryError as e:
        return Outcome("error", str(e))
    except Exception as e:  # noqa: BLE001
        return Outcome("panic", str(e))


def run_queries(queries: list[LoadedQuery], algorithms: list[str], graph: PathGraph) -> list[QueryResult]:
    out = []
    for k, query in enumerate(queries):
        result = QueryResult(k, query.id, query.text, {a: run_once(query, a, graph) for a in algorithms})
        for a, o in result.algorithms.items():
            log.info("%s %s %s: %s", k, query.id, a, o.error or o.result_count)
        out.append(result)
    return out


def timed(action, samples: int, warm_up: float, measurement: float, folder: str | None = None) -> dict:
    """Statistics of single runs, in nanoseconds: after warming up, at least `samples` runs, and on until the time for measuring is over."""
    end = time.perf_counter() + warm_up
    while time.perf_counter() < end:
        action()
    took: list[int] = []
    end = time.perf_counter() + measurement
    while len(took) < samples or time.perf_counter() < end:
        began = time.perf_counter_ns()
        action()
        took.append(time.perf_counter_ns() - began)
    if folder is not None:
        keep_samples(folder, took)
        return estimates(folder)
    return statistics_of(took)


def statistics_of(took: list[int]) -> dict:
    return {"mean_ns": statistics.fmean(took), "median_ns": float(statistics.median(took)), "stddev_ns": statistics.stdev(took) if len(took) > 1 else 0.0, "iterations": len(took)}


def keep_samples(folder: str, took: list[int]) -> None:
    """sample.json has the times of single runs, estimates.json what they come to."""
    os.makedirs(folder, exist_ok=True)
    found = statistics_of(took)
    points = {k: {"point_estimate": found[n]} for k, n in (("mean", "mean_ns"), ("median", "median_ns"), ("std_dev", "stddev_ns"))}
    replace_json(os.path.join(folder, "sample.json"), {"iters": [1.0] * len(took), "times": [float(x) for x in took]})
    replace_json(os.path.join(folder, "estimates.json"), points)


def estimates(folder: str) -> dict:
    """The statistics that a folder of a timed run has."""
    try:
        with open(os.path.join(folder, "estimates.json"), encoding="utf-8") as f:
            points = json.load(f)
        with open(os.path.join(folder, "sample.json"), encoding="utf-8") as f:
            sample = json.load(f)
        return {"mean_ns": points["mean"]["point_estimate"], "median_ns": points["median"]["point_estimate"], "stddev_ns": points["std_dev"]["point_estimate"], "iterations": int(sum(sample["iters"]))}
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise BenchError(f"can't read the estimates in {folder}: {e}") from e


def bench_one(query: LoadedQuery, algorithm: str, graph: PathGraph, args, number: int = 0) -> Outcome:
    """Times the whole of preparing and running, and running alone."""
    if isinstance(query.parsed, Exception):
        return Outcome("error", str(query.parsed))
    evaluator = ALGORITHMS[algorithm]()
    try:
        prepared = evaluator.prepare(query.parsed, graph)
        count = prepared.execute().result_count
        limits = args.sample_size, args.warm_up, args.measurement
        folder = lambda what: os.path.join(args.criterion_dir, f"{number}-{algorithm}", what) if getattr(args, "criterion_dir", None) else None
        total = timed(lambda: evaluator.evaluate(query.parsed, graph).result_count, *limits, folder("total"))
        alone = timed(lambda: prepared.execute().result_count, *limits, folder("execute_only"))
        return Outcome("ok", result_count=count, timing={"total": total, "execute_only": alone})
    except QueryError as e:
        return Outcome("error", str(e))
    except Exception as e:  # noqa: BLE001
        return Outcome("panic", str(e))


def bench_queries(queries: list[LoadedQuery], algorithms: list[str], graph: PathGraph, args, checkpoint: Checkpoint) -> list[QueryResult]:
    """Pairs that the checkpoint has are skipped, and are not in the results."""
    out = []
    for k, query in enumerate(queries):
        result = QueryResult(k, query.id, query.text)
        for a in algorithms:
            if checkpoint.done(k, a):
                continue
            result.algorithms[a] = bench_one(query, a, graph, args, k)
            checkpoint.mark_and_save(k, a, args.checkpoint)
            log.info("%s %s %s: %s", k, query.id, a, result.algorithms[a].status)
        if result.algorithms:
            out.append(result)
    return out
