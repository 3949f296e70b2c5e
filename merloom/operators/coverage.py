"""How well the first k antigens cover a population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merloom.functions.mers import exploded, mer_set
from merloom.functions.once import once
from merloom.operators.offby import near_mers
from merloom.operators.tally import mer_tally, place_tally, tally_total, weighted


#: Antigens at most, as they are numbered in one task.
ANTIGENS = 1_000_000


def antigen_numbers(antigens: DataFrame) -> DataFrame:
    """k (1, 2, ... by ord), name, seq. Antigens are few: this window runs in one task, and more than ANTIGENS are an error."""
    k = F.row_number().over(Window.orderBy("ord"))
    return antigens.select(k.alias("k"), "name", "seq").withColumn("k", F.when(F.col("k") > ANTIGENS, F.raise_error("too many antigens").cast("int")).otherwise(F.col("k")))


def first_antigen(antigens: DataFrame, e: int) -> DataFrame:
    """mer, k: the first antigen that holds each mer."""
    return exploded(antigen_numbers(antigens), "seq", e, ["k"]).groupBy("mer").agg(F.min("k").alias("k"))


def _curve(antigens: DataFrame, gains: DataFrame, *sums: str) -> DataFrame:
    """One row for each k with the running sums of the gains of the antigens up to k."""
    order = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    table = antigen_numbers(antigens).select("k").join(gains, "k", "left")
    return table.select("k", *(F.sum(F.coalesce(F.col(s), F.lit(0))).over(order).alias(s) for s in sums))


def micro_curve(population: DataFrame, antigens: DataFrame, e: int) -> DataFrame:
    """k, covered, total, share: counts of population mers that stand in one of the first k antigens."""
    tally = mer_tally(population, e)
    gains = tally.join(first_antigen(antigens, e), "mer", "left").groupBy("k").agg(F.sum("cnt").alias("covered"))
    total = tally.agg(F.sum("cnt")).scalar()
    return _curve(antigens, gains.where("k is not null").select("k", "covered"), "covered").select("k", "covered", F.coalesce(total, F.lit(0)).alias("total"), F.try_divide(F.col("covered"), total).alias("share"))


def first_within(mers: DataFrame, first: DataFrame, e: int, d: int) -> DataFrame:
    """mer, k0 to kd: for each of the mers the least k of a mer of first_antigen() within each distance; mers without any are left out."""
    near = near_mers(mers, first, e, d).join(first, "mer").select(F.col("near_mer").alias("mer"), "dist", "k")
    return near.groupBy("mer").agg(*(F.min(F.when(F.col("dist") <= x, F.col("k"))).alias(f"k{x}") for x in range(d + 1)))


def offby_curve(population: DataFrame, antigens: DataFrame, e: int, d: int) -> DataFrame:
    """k, dist, covered: counts of population mers within dist (0 to d) of a mer of the first k antigens."""
    tally = mer_tally(population, e)
    best = first_within(tally, first_antigen(antigens, e), e, d)
    each = best.join(tally, "mer").select("cnt", F.posexplode(F.array(*(f"k{x}" for x in range(d + 1)))).alias("dist", "k")).where("k is not null")
    gains = each.groupBy("dist", "k").agg(F.sum("cnt").alias("covered"))
    grid = antigen_numbers(antigens).select("k", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("dist")).join(gains, ["k", "dist"], "left")
    order = Window.partitionBy("dist").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("k", "dist", F.sum(F.coalesce("covered", F.lit(0))).over(order).alias("covered"))


def offby_shares(population: DataFrame, antigens: DataFrame, e: int, d: int, bad_in_denominator: bool = False) -> DataFrame:
    """k, dist, covered, total, share: offby_curve() beside the sum of all counts, mers with the bad character included or not."""
    total = tally_total(population, e, bad_in_denominator).scalar()
    curve = offby_curve(population, antigens, e, d).withColumn("total", total)
    return curve.withColumn("share", F.try_divide("covered", "total"))


def macro_curve(population: DataFrame, antigens: DataFrame, e: int, weights: DataFrame | None = None, strict: bool = False, on_empty: str = "drop") -> DataFrame:
    """k, missed: the weighted mean over sequences of the percentage of their mers that the first k antigens miss.

    Sequences without a mer are left out, or raise with on_empty="error". A sequence adds one row for each antigen that
    first covers one of its mers, not one for each k.
    """
    rows = weighted(population, weights, strict) if weights is not None else population.withColumn("weight", F.lit(1.0))
    sets = once(once(rows.select("ord", "weight", "seq"), "seq").select("ord", "weight", mer_set(F.col("seq"), e).alias("m")), "m")
    if on_empty == "error":
        sets = sets.where(F.when(F.size("m") == 0, F.raise_error("a sequence without a mer").cast("boolean")).otherwise(True))
    sets = sets.where(F.size("m") > 0).withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = sets.agg(F.sum("weight")).scalar()
    hits = sets.select((F.col("weight") / F.size("m")).alias("part"), F.explode("m").alias("mer")).join(first_antigen(antigens, e), "mer")
    gains = hits.groupBy("k").agg(F.sum("part").alias("part"))
    return _curve(antigens, gains, "part").select("k", (100 * (1 - F.try_divide(F.col("part"), total))).alias("missed"))


def antigen_mers(population: DataFrame, antigens: DataFrame, e: int, weights: DataFrame | None = None) -> DataFrame:
    """k, mer, cnt, share: for each mer of antigen k the (weighted) number of sequences that hold it, 0 included."""
    rows = weighted(population, weights) if weights is not None else population.withColumn("weight", F.lit(1.0))
    wanted = exploded(antigen_numbers(antigens), "seq", e, ["k"])
    total = rows.agg(F.sum("weight")).scalar()
    tally = exploded(rows, "seq", e, ["weight"]).groupBy("mer").agg(F.sum("weight").alias("cnt"))
    cnt = F.coalesce("cnt", F.lit(0.0))
    return wanted.join(tally, "mer", "left").select("k", "mer", cnt.alias("cnt"), F.try_divide(cnt, total).alias("share"))


def site_curve(population: DataFrame, antigens: DataFrame, e: int) -> DataFrame:
    """k, pos, missed: the percentage of all sequences whose mer at a column stands in none of the first k antigens."""
    first = first_antigen(antigens, e)
    n = population.agg(F.count("*")).scalar()
    most = antigen_numbers(antigens).agg(F.max("k")).scalar()
    cells = place_tally(population, e).join(first, "mer", "left").groupBy("pos", "k").agg(F.sum("cnt").alias("cnt"))
    totals = cells.groupBy("pos").agg(F.sum("cnt").alias("all"))
    grid = totals.withColumn("k", F.explode(F.sequence(F.lit(1), most))).join(cells.where("k is not null"), ["pos", "k"], "left")
    order = Window.partitionBy("pos").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    missed = F.col("all") - F.sum(F.coalesce("cnt", F.lit(0.0))).over(order)
    return grid.select("k", "pos", (100 * missed / n).alias("missed"))


def site_means(curve: DataFrame) -> DataFrame:
    """k, missed: the mean over the columns present."""
    return curve.groupBy("k").agg(F.avg("missed").alias("missed"))


def rarest(population: DataFrame, antigens: DataFrame, e: int) -> DataFrame:
    """least, mers: the least population count of a mer of any antigen (0 if absent), and how many mers have it."""
    counts = first_antigen(antigens, e).join(mer_tally(population, e), "mer", "left").select(F.coalesce("cnt", F.lit(0)).alias("cnt"))
    return counts.groupBy("cnt").agg(F.count("*").alias("mers")).orderBy("cnt").limit(1).select(F.col("cnt").alias("least"), "mers")


def _poisson(u: Column) -> Column:
    """The Poisson(1) number that a number between 0 and 1 stands for."""
    cdf, p, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        total += p
        cdf.append(total)
        p /= k + 1
    return sum((u > F.lit(c)).cast("int") for c in cdf)


def bootstrap(population: DataFrame, antigens: DataFrame, e: int, resamples: int = 20, seed: int = 1) -> DataFrame:
    """k, mean, deviation: mean and population deviation of the covered share over resamples with replacement.

    Each sequence is drawn a Poisson(1) number of times in each resample, which needs no table of draws and no numbering;
    for many sequences this is the draw of as many as there are. A resample without a mer has no share and does not count.
    """
    return _resampled(population, antigens, e, first_antigen(antigens, e).withColumnRenamed("k", "k0"), 0, resamples, seed).drop("dist")


def offby_bootstrap(population: DataFrame, antigens: DataFrame, e: int, d: int, resamples: int = 20, seed: int = 1) -> DataFrame:
    """k, dist, mean, deviation: bootstrap() of what is covered within each distance from 0 to d, by the same draws."""
    best = first_within(mer_tally(population, e), first_antigen(antigens, e), e, d)
    return _resampled(population, antigens, e, best, d, resamples, seed)


def _resampled(population: DataFrame, antigens: DataFrame, e: int, best: DataFrame, d: int, resamples: int, seed: int) -> DataFrame:
    firsts = [f"k{x}" for x in range(d + 1)]
    rows = exploded(population, "seq", e, ["ord"]).join(best, "mer", "left").groupBy("ord", *firsts).agg(F.count("*").alias("n"))
    drawn_by = F.md5(F.concat_ws(":", F.lit(seed), "b", "ord"))
    u = (F.conv(F.substring(drawn_by, 1, 10), 16, 10).cast("double") + 0.5) / float(1 << 40)
    drawn = once(rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("u", u), "u").withColumn("n", F.col("n") * _poisson(F.col("u")))
    sums = drawn.groupBy("b", *firsts).agg(F.sum("n").alias("n"))
    sums = sums.select("b", "n", F.posexplode(F.array(*firsts)).alias("dist", "k")).groupBy("b", "dist", "k").agg(F.sum("n").alias("n"))
    whole = sums.groupBy("b", "dist").agg(F.sum("n").alias("total"))
    each = [F.explode(F.sequence(F.lit(a), F.lit(b))).alias(name) for name, a, b in (("b", 1, resamples), ("dist", 0, d))]
    grid = antigen_numbers(antigens).select("k", each[0]).select("k", "b", each[1]).join(sums.where("k is not null"), ["k", "b", "dist"], "left")
    order = Window.partitionBy("b", "dist").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    curve = grid.withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(order)).join(whole, ["b", "dist"])
    share = F.try_divide("n", "total")
    return curve.groupBy("k", "dist").agg(F.avg(share).alias("mean"), F.stddev_pop(share).alias("deviation"))


def trial_stats(scores: DataFrame) -> DataFrame:
    """mean, deviation (population), least, median, most of the column score."""
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"), F.min("score").alias("least"), F.median("score").alias("median"), F.max("score").alias("most"))
