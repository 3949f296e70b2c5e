"""Alignment columns: characters by place, entropy, consensus, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merloom.functions.once import once


def characters(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """ord, pos, ch, w: one row for each character. An empty text has none."""
    rows = df.where(F.length("seq") > 0).select("ord", (weight if weight is not None else F.lit(1.0)).alias("w"), F.posexplode(F.split("seq", "")).alias("pos", "ch"))
    return rows.select("ord", "pos", "ch", "w")


def column_counts(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """pos, ch, cnt, w, first_ord of each character at each place."""
    return characters(df, weight).groupBy("pos", "ch").agg(F.count("*").alias("cnt"), F.sum("w").alias("w"), F.min("ord").alias("first_ord"))


def entropy(df: DataFrame, keepx: bool = False, weight: Column | None = None) -> DataFrame:
    """pos, entropy: Shannon entropy (natural logarithm) of the characters at each place, `X` left out unless keepx."""
    counts = column_counts(df, weight)
    counts = counts if keepx else counts.where("ch <> 'X'")
    total = F.sum("w").over(Window.partitionBy("pos"))
    p = counts.where("w > 0").select("pos", (F.col("w") / total).alias("p"))
    return p.groupBy("pos").agg((F.sum(F.col("p") * F.log(1 / F.col("p"))) + 0.0).alias("entropy"))


def consensus(df: DataFrame) -> DataFrame:
    """pos, ch, cnt: the most frequent character at each place that all rows have; of equals the one seen first."""
    shortest = df.where("seq is not null").agg(F.min(F.length("seq"))).scalar()
    best = F.max(F.struct("cnt", (-F.col("first_ord")).alias("early"), "ch"))
    return column_counts(df).where(F.col("pos") < shortest).groupBy("pos").agg(best.alias("b")).select("pos", "b.ch", "b.cnt")


def column(df: DataFrame, places: list[int], keepx: bool = False) -> DataFrame:
    """ord, value: the characters at the given places (from 0), side by side; values with `X` are left out unless keepx."""
    out = df.select("ord", F.concat(*(F.substring("seq", n + 1, 1) for n in places)).alias("value"))
    return out if keepx else out.where(~F.contains("value", F.lit("X")))


def gap_columns(df: DataFrame) -> DataFrame:
    """pos of the places at which every row that reaches them has a gap."""
    return characters(df).groupBy("pos").agg(F.bool_and(F.col("ch") == "-").alias("gap")).where("gap").select("pos")


def _kept(df: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows with only the places in `keep` (their number is the length of an alignment, not of the data)."""
    places = keep.distinct().agg(F.array_sort(F.collect_list("pos"))).scalar()
    rows = once(once(df.withColumn("_ch", F.split("seq", "")).withColumn("_keep", places), "_ch"), "_keep")
    chosen = F.filter("_keep", lambda p: p < F.length("seq"))
    return rows.withColumn("seq", F.array_join(F.transform(chosen, lambda p: F.get("_ch", p)), "")).drop("_ch", "_keep")


def without_gap_columns(df: DataFrame) -> DataFrame:
    """The rows without the places that are gaps in all of them."""
    keep = characters(df).groupBy("pos").agg(F.bool_and(F.col("ch") == "-").alias("gap")).where("not gap")
    return _kept(df, keep.select("pos"))


def without_master_gaps(df: DataFrame) -> DataFrame:
    """The rows without the places at which the first row (by ord) has a gap."""
    master = df.where(F.col("ord") == df.where("seq is not null").agg(F.min("ord")).scalar())
    return _kept(df, characters(master).where("ch <> '-'").select("pos"))
