"""Mers within a Hamming distance: an equi-join on cyclic blocks.

Two mers of length e that differ in at most d < e places agree on a cyclic run of floor((e - 1) / d) characters, at one
of e offsets; only pairs that share such a run are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merloom.functions.mers import cyclic_key, hamming
from merloom.operators.skew import HOT_PAIRS, hot_keys, spread_join
from merloom.storage import written

#: Wanted mers whose keys are broadcast at most; more are joined by a shuffle, with hot keys spread.
WANTED = 100_000


def _keyed(df: DataFrame, e: int, size: int, name: str) -> DataFrame:
    """A row for each offset of each mer: the mer and its key, offset and cyclic run."""
    places = df.select(F.col("mer").alias(name), F.explode(F.sequence(F.lit(0), F.lit(e - 1))).alias("_k"))
    return places.select(name, F.concat(F.col("_k").cast("string"), F.lit(":"), cyclic_key(F.col(name), F.col("_k"), size)).alias("_key"))


def near_mers(mers: DataFrame, wanted: DataFrame, e: int, d: int, most: int = WANTED, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """mer, near_mer, dist: for each wanted mer the mers at distance at most d; with d = 0 the wanted mers that exist.

    The keys of up to `most` wanted mers are broadcast, so the other mers are keyed and compared where they are; beyond
    that both sides are shuffled by key, keys of low complexity spread over tasks. d must be below e, as mers without a
    common character share no key.
    """
    if d >= e:
        raise ValueError("d must be below e")
    own, all_ = written(wanted.select("mer").distinct(), "wanted"), mers.select("mer").distinct()
    if d == 0:
        return own.join(all_, "mer").select("mer", F.col("mer").alias("near_mer"), F.lit(0).alias("dist"))
    a, b = _keyed(own, e, (e - 1) // d, "mer"), _keyed(all_, e, (e - 1) // d, "near_mer")
    if own.count() <= most:
        pairs = b.join(F.broadcast(a), "_key")
    else:
        b = written(b, "keys")
        sizes = a.groupBy("_key").agg(F.count("*").alias("l")).join(b.groupBy("_key").agg(F.count("*").alias("r")), "_key")
        pairs = spread_join(b, a, "_key", hot_keys(sizes.select("_key", (F.col("l") * F.col("r")).alias("made")), "_key", "made", hot_pairs))
    pairs = pairs.select("mer", "near_mer", hamming(F.col("mer"), F.col("near_mer")).alias("dist"))
    return pairs.where(F.col("dist") <= d).distinct()


def neighbours(mers: DataFrame, wanted: DataFrame, e: int, d: int) -> DataFrame:
    """near_mers() without the mer itself."""
    return near_mers(mers, wanted, e, d).where("dist > 0")
