"""Columns that are worked out once a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, column: str) -> DataFrame:
    """The same rows; the column is worked out once, even where later expressions use it for every element of an array.

    Catalyst merges neighbouring projections and moves filters below them, which would put a costly expression into each
    place that uses it; it moves nothing past a generator's output.
    """
    return df.select(*(c for c in df.columns if c != column), F.explode(F.array(column)).alias(column)).select(*df.columns)
