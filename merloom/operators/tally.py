"""Counts of mers, plain, weighted and by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merloom.functions.mers import BAD, GAP, exploded, gapped_rows, mers, residue_places
from merloom.functions.once import once


def mer_tally(df: DataFrame, e: int, rmx: bool = True, rmdash: bool = True) -> DataFrame:
    """mer, cnt: in how many rows each mer stands. Null and short texts hold none."""
    return exploded(df, "seq", e, [], True, rmdash, rmx).groupBy("mer").agg(F.count("*").alias("cnt"))


def weight_table(df: DataFrame) -> DataFrame:
    """name, weight: the last line (by line_no) of each name; rows with a null name or weight are left out."""
    return df.where("name is not null and weight is not null").groupBy("name").agg(F.max_by("weight", "line_no").alias("weight"))


def weighted(df: DataFrame, weights: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with their weight: 1.0 where the name has none, or with `strict` an error."""
    missing = F.raise_error(F.concat(F.lit("no weight for "), F.coalesce("name", F.lit("null")))).cast("double") if strict else F.lit(1.0)
    table = weights.select(F.col("name").alias("_name"), F.col("weight").alias("_weight"))
    return df.join(table, F.col("name") == F.col("_name"), "left").withColumn("weight", F.coalesce("_weight", missing)).drop("_name", "_weight")


def weighted_tally(df: DataFrame, weights: DataFrame, e: int) -> DataFrame:
    """mer, cnt: the sum of the weights of the rows with the mer."""
    return exploded(weighted(df, weights), "seq", e, ["weight"]).groupBy("mer").agg(F.sum("weight").alias("cnt"))


def tally_total(df: DataFrame, e: int, bad_in_denominator: bool = False) -> DataFrame:
    """total: the sum of all counts, mers with the bad character included or not."""
    counts = mer_tally(df, e, rmx=False)
    good = F.lit(True) if bad_in_denominator else ~F.contains("mer", F.lit(BAD))
    return counts.agg(F.coalesce(F.sum(F.when(good, F.col("cnt"))), F.lit(0)).alias("total"))


def without_bad(counts: DataFrame) -> DataFrame:
    """Counts without mers that hold the bad character; one with an unknown residue X raises."""
    unknown = F.raise_error("a mer holds X").cast("boolean")
    return counts.where(F.when(F.contains("mer", F.lit("X")), unknown).otherwise(~F.contains("mer", F.lit(BAD))))


def end_mers(df: DataFrame, e: int) -> DataFrame:
    """mer, is_first, is_last: the mers that begin or end a row."""
    ends = once(once(df.select("seq"), "seq").select(mers(F.col("seq"), e).alias("m")), "m").where(F.size("m") > 0).select(F.explode(F.array(F.struct(F.element_at("m", 1).alias("mer"), F.lit(True).alias("a")), F.struct(F.element_at("m", -1).alias("mer"), F.lit(False).alias("a")))).alias("x"))
    return ends.groupBy("x.mer").agg(F.bool_or("x.a").alias("is_first"), F.bool_or(~F.col("x.a")).alias("is_last"))


def place_tally(df: DataFrame, e: int, weight: Column | None = None) -> DataFrame:
    """pos, mer, cnt: the weight of the rows whose window of e residues begins at a column; mers with the bad character are left out."""
    rows = gapped_rows(df.select((weight if weight is not None else F.lit(1.0)).alias("w"), "seq"), e, ["w"])
    return rows.where(~F.contains("mer", F.lit(BAD))).groupBy("pos", "mer").agg(F.sum("w").alias("cnt"))


def reference_sites(df: DataFrame) -> DataFrame:
    """pos, site: for each column of the first row (by ord) the number of residues before it; its last row holds for columns beyond."""
    ref = df.agg(F.min_by("seq", "ord").alias("ref"))
    return ref.select(F.posexplode(F.split(F.col("ref"), "")).alias("pos", "ch"), F.col("ref")).select("pos", F.length(F.replace(F.left("ref", F.col("pos")), F.lit(GAP), F.lit(""))).alias("site"))


def site_tally(df: DataFrame, e: int) -> DataFrame:
    """site, mer, cnt: the place tally by residues of the first row."""
    ref = df.agg(F.min_by("seq", "ord")).scalar()
    site = F.length(F.replace(F.left(F.coalesce(ref, F.lit("")), F.col("pos")), F.lit(GAP), F.lit("")))
    return place_tally(df, e).withColumn("site", site).groupBy("site", "mer").agg(F.sum("cnt").alias("cnt"))


def mer_places(df: DataFrame, e: int) -> DataFrame:
    """mer, positions: the sorted columns at which a mer begins in any row. A mer has at most as many as there are columns."""
    return gapped_rows(df, e, []).groupBy("mer").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def places_of_mers(places: DataFrame, wanted: DataFrame) -> DataFrame:
    """positions: all columns at which any of the wanted mers begins."""
    return places.join(wanted.select("mer").distinct(), "mer", "left_semi").select(F.explode("positions").alias("pos")).distinct()


def gapped_places(df: DataFrame, e: int) -> DataFrame:
    """ord, gapped, pos: each window of e residues with its gaps; the last place if it occurs more than once in a row; the bad character is left out."""
    rows = gapped_rows(df, e, ["ord"], gapped=True).where(~F.contains("gapped", F.lit(BAD)))
    return rows.groupBy("ord", "gapped").agg(F.max("pos").alias("pos"))


def length_stats(df: DataFrame) -> DataFrame:
    """len, rows, least, most, all_rows: the histogram of lengths beside the extremes."""
    hist = df.where("seq is not null").groupBy(F.length("seq").alias("len")).agg(F.count("*").alias("rows"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    return hist.select("len", "rows", F.min("len").over(whole).alias("least"), F.max("len").over(whole).alias("most"), F.sum("rows").over(whole).alias("all_rows"))


def residue_map(df: DataFrame) -> DataFrame:
    """ord, places: the columns of each row's residues."""
    return once(df.select("ord", "seq"), "seq").select("ord", residue_places(F.col("seq")).alias("places"))
