"""The corpus pipeline: five stages from raw documents to a training mix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailweave.llm import decontaminate, language_id, mix_sources, secret_scan, simhash_dedup
from trailweave.llm.common import table
from trailweave.storage import dropped, path_of, scratch, written

#: Each works on all rows that its predecessor kept; all but the last return the columns of documents.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id.keep_accepted),
    ("simhash_dedup", simhash_dedup.keep_one),
    ("decontaminate", decontaminate.keep_clean),
    ("secret_scan", secret_scan.redact),
    ("mix_sources", mix_sources.training_mix),
]

#: Language models, fingerprints and compressed sizes are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each stage's rows are written as Parquet and read again as the next one's input."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as made:  # what a stage writes for itself goes when its rows are there
            docs = written(stage(spark, docs, sf_dir), name)
            made.remove(path_of(docs))
        if before is not None:
            dropped(before)
        before = docs
    return docs
