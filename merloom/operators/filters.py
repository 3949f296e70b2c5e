"""Filters and projections of a sequence set: rows (ord, name, seq), in order of ord."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merloom.functions.mers import mers, repeated_mers
from merloom.functions.once import once
from merloom.storage import written

#: Characters that mean a bad residue, and the one that means a stop.
BAD_SIGNS, STOP_SIGN = "#Xx", "$"


def _name(df: DataFrame) -> Column:
    return F.coalesce(F.col("name"), F.lit(""))


def by_pattern(df: DataFrame, pattern: str | None = None, xpattern: str | None = None) -> DataFrame:
    """Rows whose name matches `pattern` somewhere and `xpattern` nowhere; a null name counts as empty."""
    if pattern:
        df = df.where(_name(df).rlike(pattern))
    return df.where(~_name(df).rlike(xpattern)) if xpattern else df


def by_patterns(df: DataFrame, patterns: list[str], exclude: bool = False, keepfirst: bool = False, ignorecase: bool = True) -> DataFrame:
    """Rows whose name matches any of the patterns (with `exclude`: none). `keepfirst` also keeps the first row; the pattern "Global" keeps all rows."""
    if "Global" in patterns:
        return df
    any_ = reduce(lambda a, b: a | b, [_name(df).rlike(("(?i)" if ignorecase else "") + p) for p in patterns], F.lit(False))
    keep = ~any_ if exclude else any_
    return df.where(keep | (F.col("ord") == df.agg(F.min("ord")).scalar())) if keepfirst else df.where(keep)


def cleaned(seq: Column, rmdash: bool = False, toupper: bool = True, badchar: str | None = None, reverse: bool = False) -> Column:
    """Gaps out, upper case, bad signs, reversal, in this order."""
    seq = F.replace(seq, F.lit("-"), F.lit("")) if rmdash else seq
    seq = F.upper(seq) if toupper else seq
    seq = F.translate(seq, BAD_SIGNS + STOP_SIGN, badchar * len(BAD_SIGNS) + "*") if badchar else seq
    return F.reverse(seq) if reverse else seq


def first_of_each(df: DataFrame, column: str = "seq") -> DataFrame:
    """The first row (by ord) of each text; rows with an empty or null text all stay. A text of a third of all rows is combined before the shuffle."""
    bare = (F.length(column) == 0) | F.col(column).isNull()
    others = [c for c in df.columns if c not in ("ord", column)]
    first = df.where(~bare).groupBy(column).agg(F.min(F.struct("ord", *others)).alias("_r")).select(*(F.col("_r")[c].alias(c) if c != column else F.col(c) for c in df.columns))
    return df.where(bare).unionByName(first)


def filtered(df: DataFrame, pattern: str | None = None, xpattern: str | None = None, rmdash: bool = False, toupper: bool = True, badchar: str | None = None, reverse: bool = False, rmdup: bool = False, maxseqs: int | None = None) -> DataFrame:
    """All of the above in the fixed order: name patterns, cleaning, first of equal texts, first `maxseqs` rows."""
    df = by_pattern(df.select("ord", "name", "seq"), pattern, xpattern)
    df = df.withColumn("seq", cleaned(F.col("seq"), rmdash, toupper, badchar, reverse))
    df = first_of_each(df) if rmdup else df
    return df.orderBy("ord").limit(maxseqs) if maxseqs else df


def repeats(seq: Column, e: int) -> Column:
    """How many distinct mers occur more than once in the text."""
    return F.size(repeated_mers(seq, e))


def few_repeats(df: DataFrame, e: int, tmr: int, boundary: str = "lt") -> DataFrame:
    """Rows with fewer than tmr repeated mers (`lt`), or at most tmr (`le`); tmr = 0 keeps all."""
    if not tmr:
        return df
    counted = once(once(df, "seq").withColumn("_n", repeats(F.col("seq"), e)), "_n")
    return counted.where(F.col("_n") < tmr if boundary == "lt" else F.col("_n") <= tmr).drop("_n")


def too_many_repeats(seq: Column, e: int, tmr: int) -> Column:
    return repeats(seq, e) >= tmr if tmr else F.lit(False)


def with_mers(df: DataFrame, e: int) -> DataFrame:
    """Rows with at least one valid mer."""
    return once(df, "seq").where(F.size(mers(F.col("seq"), e)) > 0)


def truncated(seq: Column, lo: int, hi: int) -> Column:
    """Characters lo to hi - 1 (from 0); a text shorter than lo raises."""
    if lo > hi:
        raise ValueError("lo is above hi")
    return F.when(F.length(seq) < lo, F.raise_error("a text ends before the range")).otherwise(F.substring(seq, lo + 1, hi - lo))


def design_filter(df: DataFrame, e: int, reverse: bool = False, tmr: int = 0, span: tuple[int, int] | None = None, boundary: str = "lt") -> DataFrame:
    """Reversal, repeats, truncation, and the drop of rows without a mer, in this order."""
    df = df.withColumn("seq", F.reverse("seq")) if reverse else df
    df = few_repeats(df, e, tmr, boundary)
    df = df.withColumn("seq", truncated(F.col("seq"), *span)) if span else df
    return with_mers(df, e)


def same_length(df: DataFrame) -> DataFrame:
    """The rows, or an error at run time if their texts differ in length."""
    ends = df.agg(F.min(F.length("seq")).alias("a"), F.max(F.length("seq")).alias("b"))
    uneven = ends.select(F.col("a") != F.col("b")).scalar()
    return df.where(F.when(uneven, F.raise_error("texts of different length").cast("boolean")).otherwise(True))


def first_rows(df: DataFrame, m: int | None) -> DataFrame:
    """The first m rows by ord; all if m is null or below 1; an error if there are fewer."""
    if not m or m < 1:
        return df
    have = df.agg(F.count("*")).scalar()
    return df.orderBy("ord").limit(m).where(F.when(have < m, F.raise_error("fewer rows than asked for").cast("boolean")).otherwise(True))


def drawn(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn with replacement: (draw, ord, name, seq). The rows are numbered by partition and place, without a sort in one task."""
    rows = numbered(df)
    drawn_by = F.md5(F.concat_ws(":", F.lit(seed), F.col("id")))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.conv(F.substring(drawn_by, 1, 15), 16, 10).cast("bigint"), F.lit(max(1, df.count()))).alias("_n"))
    return draws.join(rows, "_n").drop("_n")


def numbered(df: DataFrame, column: str = "_n") -> DataFrame:
    """Rows with the numbers 0, 1, 2, ... in order of ord: range partitions, their sizes, then the place in each."""
    # written, as the numbers of partitions must be the same in both uses
    parts = written(df.repartitionByRange("ord").withColumn("_p", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_p").orderBy("ord")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))
    return parts.withColumn("_i", F.row_number().over(own) - 1).join(F.broadcast(before), "_p").withColumn(column, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")
