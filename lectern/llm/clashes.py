"""Columns of a table whose names an operator gives to its own results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(name: str, columns: list[str]) -> str:
    """`name`, or a longer one that no column has (names are compared without regard to case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def filtered(df: DataFrame, names: list[str], operator: Callable[[DataFrame], DataFrame], condition: str) -> DataFrame:
    """Rows of `operator(df)` that meet a condition on its result columns `names`, with the columns of `df` and no others.

    Columns of `df` with such names step aside while the operator runs and come back as they were.
    """
    aside = {c: fresh(f"_{c}_before", df.columns) for c in df.columns if c in names}
    out = operator(df.withColumnsRenamed(aside)).filter(condition)
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in df.columns])
