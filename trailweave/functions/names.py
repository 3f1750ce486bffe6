"""Column functions for names of vertices and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_name(name: Column) -> Column:
    """A name without outer white space and without one pair of angle brackets."""
    name = F.trim(name)
    return F.when((F.length(name) >= 2) & name.startswith("<") & name.endswith(">"), F.substring(name, F.lit(2), F.length(name) - F.lit(2))).otherwise(name)


def with_base(name: Column, base: str | None) -> Column:
    """A name with the base IRI put before it."""
    return F.concat(F.lit(base), name) if base else name
