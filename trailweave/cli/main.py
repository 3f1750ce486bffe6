"""Command line: `python -m trailweave query ...` and `python -m trailweave bench ...`."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from ..errors import TrailError
from ..sources.query_file import load_queries
from .checkpoint import Checkpoint
from .output import write_json
from .run import ALGORITHMS, bench_queries, load_graph, metadata, run_queries

DEFAULT_BASE = "http://example.org/"


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-g", "--graph", required=True, help="directory (mm) or file (csv, rdf)")
    common.add_argument("-f", "--format", choices=["mm", "csv", "rdf"], default="mm")
    common.add_argument("-q", "--queries", required=True, help="a line is an id, a comma and a path pattern")
    common.add_argument("-b", "--base-iri", nargs="?", const=DEFAULT_BASE, default=None, help=f"BASE of the patterns; without a value {DEFAULT_BASE}")
    common.add_argument("-a", "--algo", nargs="+", action="extend", choices=sorted(ALGORITHMS), required=True)
    out = argparse.ArgumentParser(prog="trailweave", description="Regular path queries over edge-labelled graphs")
    commands = out.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query", parents=[common], help="run each query once")
    query.add_argument("-o", "--output", help="JSON file for the results")
    bench = commands.add_parser("bench", parents=[common], help="time each query")
    bench.add_argument("-o", "--output", default="bench_results.json")
    bench.add_argument("-c", "--checkpoint", default="bench_checkpoint.json")
    bench.add_argument("--resume", action="store_true", help="skip what the checkpoint has")
    bench.add_argument("--criterion-dir", help="folder for each query's samples and estimates, as JSON")
    bench.add_argument("--plots", action="store_true", help="refused: no plots are made")
    bench.add_argument("--sample-size", type=int, default=10)
    bench.add_argument("--warm-up", type=float, default=1, help="seconds")
    bench.add_argument("--measurement", type=float, default=5, help="seconds")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    args.algo = list(dict.fromkeys(args.algo))
    if getattr(args, "plots", False):
        print("error: plots aren't made; --criterion-dir keeps the samples to plot", file=sys.stderr)
        return 1
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(message)s")
    spark = SparkSession.builder.appName("trailweave").getOrCreate()
    try:
        graph = load_graph(spark, args.graph, args.format, args.base_iri)
        queries = load_queries(args.queries, args.base_iri)
        if args.command == "query":
            results = run_queries(queries, args.algo, graph)
            if args.output:
                write_json(args.output, metadata(graph, args), results)
            return 0
        checkpoint = Checkpoint.load(args.checkpoint) if args.resume else None
        if checkpoint is not None:
            checkpoint.validate(args.graph, args.queries, args.algo)
        results = bench_queries(queries, args.algo, graph, args, checkpoint or Checkpoint(args.graph, args.queries, list(args.algo)))
        limits = {"sample_size": args.sample_size, "warm_up_secs": args.warm_up, "measurement_secs": args.measurement}
        write_json(args.output, metadata(graph, args) | limits, results)
        return 0
    except (TrailError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
