"""A running mer tally over a stream of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merloom.functions.mers import exploded


def windowed_tally(stream: DataFrame, e: int, time_col: str, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, mer, cnt of each time window; rows later than `late` behind the newest are dropped. Works on a static table too."""
    rows = exploded(stream.withWatermark(time_col, late), "seq", e, [time_col])
    return rows.groupBy(F.window(time_col, length), "mer").agg(F.count("*").alias("cnt")).select(F.col("window.start").alias("start"), "mer", "cnt")


def running_tally(stream: DataFrame, e: int) -> DataFrame:
    """mer, cnt over all rows so far (output mode complete or update)."""
    return exploded(stream, "seq", e, []).groupBy("mer").agg(F.count("*").alias("cnt"))
