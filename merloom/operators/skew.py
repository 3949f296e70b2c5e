"""Joins where one key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merloom.storage import written

#: Keys that count as hot at most; their table is broadcast, so this bounds it.
HOT_KEYS = 1000
#: Rows of one key that may meet in one task.
HOT_ROWS = 200_000
#: Joined rows that one key may make in one task.
HOT_PAIRS = 2_000_000


def _hot(sizes: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """_hot, _salts: the at most HOT_KEYS largest keys above `most`, and how often they fill it."""
    return sizes.where(F.col(size) > most).orderBy(F.desc(size), key).limit(HOT_KEYS).select(F.col(key).alias("_hot"), F.ceil(F.col(size) / most).cast("int").alias("_salts"))


def _salted(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """left joined with right by key; rows of the keys in hot (_hot, _salts) are spread over salts on the left and repeated for each salt on the right."""
    others = [c for c in left.columns if c != key]
    left = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*others), F.col("_salts")), F.lit(0)).cast("int")).drop("_hot", "_salts")
    right = right.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_hot", "_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def salted_join(rows: DataFrame, groups: DataFrame, key: str, size: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of rows with groups (one row for each key, `size` = its number of rows).

    The at most HOT_KEYS largest keys above `hot_rows` rows are spread over as many salts as they fill; the rest, at
    any size, join by the key alone. Null keys match nothing. Columns of `rows` come first, then those of `groups`.
    """
    return _salted(rows, groups, key, _hot(groups, key, size, hot_rows))


def hot_keys(sizes: DataFrame, key: str, size: str, most: int) -> DataFrame | None:
    """The hot keys of a table of keys and sizes, for spread_join(), worked out once; none if there is no hot key."""
    hot = written(_hot(sizes, key, size, most), "hot")
    return None if hot.isEmpty() else hot


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Inner join of two sides that may both hold many rows of a key: those in `hot`, from hot_keys(), are spread over their salts by the left side's other columns and repeated on the right; the rest join by the key alone. Null keys match nothing."""
    return left.join(right, key) if hot is None else _salted(left, right, key, hot)
