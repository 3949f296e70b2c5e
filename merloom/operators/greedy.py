"""Long mers that together hold the most short mers, picked greedily."""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merloom.functions.mers import tiled_mers
from merloom.functions.once import once
from merloom.operators import compact
from merloom.operators.tally import mer_tally
from merloom.storage import forget, written


def long_mers(df: DataFrame, k: int, stride: int = 1) -> DataFrame:
    """kmer: the distinct mers of all rows."""
    return once(df.select("seq"), "seq").select(F.explode(tiled_mers(F.col("seq"), k, stride)).alias("kmer")).where(F.length("kmer") == k).distinct()


def tiles(df: DataFrame, k: int, e: int) -> DataFrame:
    """kmer: mers of the rows at the stride that misses no short mer."""
    return once(df.select("seq"), "seq").select(F.explode(tiled_mers(F.col("seq"), k, k - e + 1)).alias("kmer")).distinct()


def membership(pool: DataFrame, e: int) -> DataFrame:
    """kmer, mer: the distinct short mers of each long one."""
    return pool.select("kmer", F.explode(tiled_mers(F.col("kmer"), e)).alias("mer")).where(F.length("mer") == e)


def scores(pool: DataFrame, counts: DataFrame, e: int) -> DataFrame:
    """kmer, score: the sum of the counts of its distinct short mers, absent ones 0."""
    return membership(pool, e).join(counts, "mer", "left").groupBy("kmer").agg(F.sum(F.coalesce("cnt", F.lit(0))).alias("score"))


def union_score(pool: DataFrame, counts: DataFrame, e: int) -> DataFrame:
    """score: the sum of the counts of all short mers in the pool, each once."""
    return membership(pool, e).select("mer").distinct().join(counts, "mer").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("score"))


def best_quarter(scored: DataFrame) -> DataFrame:
    """The quarter of the pool with the highest scores (ties by mer)."""
    return scored.orderBy(F.desc("score"), "kmer").limit(scored.count() // 4)


def greedy(members: DataFrame | compact.Pool | compact.Heads, n: int, given: list[str] | None = None) -> list[tuple[str, int]]:
    """(kmer, gain) of n picks: the given ones first, then each time the mer with the largest sum of counts not yet covered.

    `members` is (kmer, mer, cnt), or a pool of runs, or the heads of texts. Ties go to the smaller mer; when all is covered, picks gain 0. Scores are summed once;
    a pick takes from them what its short mers (k - e + 1 at most) gave to the mers that hold these.
    """
    given = given or []
    if len(given) > n:
        raise ValueError("more mers given than asked for")
    if isinstance(members, compact.Pool):
        return compact.pool_greedy(members, n, given)
    if isinstance(members, compact.Heads):
        return compact.head_greedy(members, n, given)
    scores = written(members.groupBy("kmer").agg(F.sum("cnt").alias("score")), "scores")
    lost: list[DataFrame] = []
    picks: list[tuple[str, int]] = []
    covered: set[str] = set()
    for turn in range(n):
        if turn < len(given):
            pick = given[turn]
        else:
            left = scores
            if lost:
                gone = reduce(DataFrame.unionByName, lost).groupBy("kmer").agg(F.sum("lost").alias("lost"))
                left = scores.join(gone, "kmer", "left").select("kmer", (F.col("score") - F.coalesce("lost", F.lit(0))).alias("score"))
            row = left.orderBy(F.desc("score"), "kmer").first()
            if row is None:
                break
            pick = row["kmer"]
        new = {r["mer"]: r["cnt"] for r in members.where(F.col("kmer") == pick).select("mer", "cnt").distinct().collect() if r["mer"] not in covered}
        picks.append((pick, sum(new.values())))
        covered |= new.keys()
        if new:
            lost.append(written(members.where(F.col("mer").isin(*new)).groupBy("kmer").agg(F.sum("cnt").alias("lost")), "lost"))
    forget(scores, *lost)
    return picks


def member_counts(df: DataFrame, k: int, e: int, pool: DataFrame | None = None) -> DataFrame:
    """kmer, mer, cnt of the pool (by default all long mers of the rows), as a written table."""
    counts = mer_tally(df, e, rmx=False, rmdash=False)
    return written(membership(pool if pool is not None else long_mers(df, k), e).join(counts, "mer", "left").select("kmer", "mer", F.coalesce("cnt", F.lit(0)).alias("cnt")), "members")


def top_mers(df: DataFrame, k: int, e: int, n: int, quarter: bool = False, initial: DataFrame | None = None, trials: int = 0, seed: int = 1) -> DataFrame:
    """pick, kmer, score: the greedy picks, from the whole pool or its best quarter.

    The tiles of `initial` rows come first and join the pool; more than n of them are an error. With `trials` the picks
    are improved in rounds, see refined(), in which initial picks are free too.
    """
    pool, given = None, []
    if initial is not None:
        first = tiles(initial, k, e).where(F.length("kmer") == k)
        given = [r["kmer"] for r in first.orderBy("kmer").limit(n + 1).collect()]
        pool = long_mers(df, k).unionByName(first).distinct()
    members = member_counts(df, k, e, pool)
    if quarter:
        best = best_quarter(members.groupBy("kmer").agg(F.sum("cnt").alias("score"))).select("kmer")
        kept = best.unionByName(df.sparkSession.createDataFrame([(m,) for m in given], "kmer string")).distinct()
        members = written(members.join(kept, "kmer", "left_semi"), "quarter")
    picks = refined(members, n, trials, seed, given) if trials else greedy(members, n, given)
    return df.sparkSession.createDataFrame([(i + 1, m, s) for i, (m, s) in enumerate(picks)], "pick int, kmer string, score bigint")


def _total(picks: list[tuple[str, int]]) -> int:
    return sum(s for _, s in picks)


def restarted(members: DataFrame, n: int, seed: int = 1, fix: float = 0.5) -> list[tuple[str, int]]:
    """Picks around a random share of the pool, and then again around those that were not random."""
    if isinstance(members, compact.Heads):
        drawn = sorted(members.drawn(seed, math.ceil(fix * n)))
    else:
        kmers = compact.pool_scores(members).select("kmer") if isinstance(members, compact.Pool) else members.select("kmer").distinct()
        some = kmers.orderBy(F.xxhash64(F.lit(seed), "kmer"), "kmer").limit(math.ceil(fix * n))
        drawn = sorted(r["kmer"] for r in some.collect())
    return greedy(members, n, [m for m, _ in greedy(members, n, drawn)[len(drawn) :]])


def tweaked(members: DataFrame, best: list[tuple[str, int]], trials: int, fix: float, rng: random.Random) -> list[tuple[str, int]]:
    """The best of the given picks and of trials that keep a random share of the best so far and choose the others again."""
    for _ in range(trials):
        kept = rng.sample([m for m, _ in best], math.ceil(fix * len(best)))
        best = max(best, greedy(members, len(best), kept), key=_total)
    return best


def refined(members: DataFrame, n: int, trials: int = 10, seed: int = 1, given: list[str] | None = None) -> list[tuple[str, int]]:
    """Greedy picks, against a restart from random ones that is tweaked once with half of the picks kept, then both tweaked by `trials` trials with nine tenths kept; the best of all."""
    rng = random.Random(f"{seed}:refined")
    best = greedy(members, n, given)
    other = tweaked(members, restarted(members, n, seed), 1, 0.5, rng) if best else best
    best = max(best, tweaked(members, other, trials, 0.9, rng), key=_total)
    return tweaked(members, best, trials, 0.9, rng)
