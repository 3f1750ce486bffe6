"""Edges from delimited text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MissingColumn


def read_csv(spark: SparkSession, path: str | Sequence[str], source: int | str = 0, target: int | str = 1, label: int | str = 2, header: bool = True, delimiter: str = ",") -> DataFrame:
    """(source, label, target) of CSV files. Columns are given by place or, if there is a header, by name; by default source, target, label. A short or broken record fails the read."""
    reader = spark.read.option("header", header).option("sep", delimiter).option("mode", "FAILFAST").option("inferSchema", False).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "")
    rows = reader.csv(path)
    names = rows.columns

    def found(spec: int | str):
        if isinstance(spec, int):
            if spec >= len(names):
                raise MissingColumn(f"index {spec}")
            return rows[f"`{names[spec]}`"]
        if not header or spec not in names:
            raise MissingColumn(spec)
        return rows[f"`{spec}`"]

    chosen = [(found(spec), name) for spec, name in ((source, "source"), (label, "label"), (target, "target"))]
    return rows.select(*(F.coalesce(c, F.raise_error(F.lit(f"column '{name}' is missing in a record")).cast("string")).alias(name) for c, name in chosen))
