"""Best ways through an acyclic mer graph, and sets of them that complement each other."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merloom.operators.contract import HOPS, Chains, contracted, followed
from merloom.operators.graph import BEGIN, END
from merloom.storage import forget, written


def best_values(nodes: DataFrame, edges: DataFrame, widest: bool = False, chains: Chains | None = None) -> DataFrame:
    """mer, value, pre: the largest sum of counts on a way from BEGIN (with `widest` the largest least count), and the smallest of the best predecessors.

    Rounds of relaxation over the links between branches whose source changed, HOPS links a round; as many as the longest
    way needs. A cycle raises once the links gone exceed the number of nodes between links. `chains` is contracted(edges),
    if that is at hand.
    """
    spark = edges.sparkSession
    chains = contracted(edges) if chains is None else chains
    start = F.lit(999_999 if widest else 0).cast("double")
    counts = nodes.select("mer", F.col("cnt").cast("double").alias("cnt"))
    inside = chains.members.join(counts, "mer")
    gains = inside.groupBy("chain").agg((F.min("cnt") if widest else F.sum("cnt")).alias("gain"))
    ways = chains.links.join(gains, "chain", "left").join(counts.select(F.col("mer").alias("dst"), "cnt"), "dst")
    if widest:
        own, nothing = F.when(F.col("dst") == END, F.coalesce("gain", start)).otherwise(F.least("gain", "cnt")), start
        reached = F.least("value", "own")
    else:
        own, nothing = F.coalesce("gain", F.lit(0.0)) + F.col("cnt"), F.lit(0.0)
        reached = F.col("value") + F.col("own")
    ways = ways.select("src", "dst", "last", own.alias("own"))
    # a way from each node to itself, so that HOPS joins go on up to HOPS links
    stay = chains.links.select(F.explode(F.array("src", "dst")).alias("src")).distinct().select("src", F.col("src").alias("dst"), F.lit(None).cast("string").alias("last"), nothing.alias("own"))
    ways = written(ways.unionByName(stay), "ways")
    values = changed = written(spark.range(1).select(F.lit(BEGIN).alias("mer"), start.alias("value"), F.lit(None).cast("string").alias("pre")), "values")
    rounds, most = 0, ways.select("dst").distinct().count() + 1
    while True:
        rounds += 1
        if (rounds - 1) * HOPS > most + 1:
            raise ValueError("the graph has a cycle")
        offers = changed
        for _ in range(HOPS):
            # of equal predecessors the smallest name
            best = F.min(F.struct((-reached).alias("n"), F.coalesce("last", "pre").alias("pre"))).alias("x")
            offers = ways.join(offers.select(F.col("mer").alias("src"), "value", "pre"), "src").groupBy(F.col("dst").alias("mer")).agg(best).select("mer", (-F.col("x.n")).alias("value"), F.col("x.pre").alias("pre"))
        old = values.select("mer", F.col("value").alias("old"), F.col("pre").alias("old_pre"))
        both = offers.join(old, "mer", "full")
        up = F.col("value").isNotNull() & (F.col("old").isNull() | (F.col("value") > F.col("old")))
        same = (F.col("value") == F.col("old")) & (F.col("pre") < F.col("old_pre"))
        new = written(both.select("mer", F.when(up, F.col("value")).otherwise(F.col("old")).alias("value"), F.when(up | same, F.col("pre")).otherwise(F.col("old_pre")).alias("pre"), up.alias("up")), "values")
        forget(values)
        values, changed = new.drop("up"), new.where("up").drop("up")
        values._written_to = new._written_to
        if changed.isEmpty():
            break
    # nodes within chains: what their source has, and the counts up to them
    so_far = Window.partitionBy("chain").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    along = inside.select("chain", "mer", "off", (F.min("cnt") if widest else F.sum("cnt")).over(so_far).alias("own"), F.lag("mer").over(Window.partitionBy("chain").orderBy("off")).alias("before"))
    heads = chains.links.where("chain is not null").join(values.select(F.col("mer").alias("src"), "value"), "src").select("chain", "src", "value")
    within = along.join(heads, "chain").select("mer", reached.alias("value"), F.coalesce("before", "src").alias("pre"))
    found = written(values.unionByName(within), "values")
    forget(ways, values)
    return found


def best_path(nodes: DataFrame, edges: DataFrame, chains: Chains | None = None) -> tuple[float, list[str]]:
    """The score of a best way, and its mers: from END back, always the smallest best predecessor."""
    values = best_values(nodes, edges, chains=chains)
    score = values.where(F.col("mer") == END).first()
    if score is None:
        raise ValueError("END can't be reached from BEGIN")
    path = followed(values.where("pre is not null").select("mer", F.col("pre").alias("to")), END, BEGIN)
    forget(values)
    return score["value"], path[::-1]


def path_scores(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """score: the sum of the counts of the distinct mers of all paths (path_id, step, mer) that are nodes."""
    return nodes.join(paths.select("mer").distinct(), "mer", "left_semi").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("score"))


def _table(df: DataFrame, paths: list[list[str]]) -> DataFrame:
    """mer: the distinct mers of paths, each as long as a sequence."""
    return df.sparkSession.createDataFrame([(x,) for x in sorted({x for p in paths for x in p})], "mer string")


def covered_score(nodes: DataFrame, paths: list[list[str]]) -> float:
    """The sum of the counts of the nodes on the paths."""
    return float(nodes.join(F.broadcast(_table(nodes, paths)), "mer", "left_semi").agg(F.sum("cnt")).first()[0] or 0)


def complementary_ways(nodes: DataFrame, edges: DataFrame, m: int, fixed: list[list[str]] | None = None, extra: int = 0, start: list[list[str]] | None = None, chains: Chains | None = None) -> tuple[float, list[list[str]]]:
    """What up to m ways cover, and the ways; each is best for what the others leave uncovered.

    The fixed ways stay; those in `start` come next and may be replaced. While there are fewer than m a way is added if
    it gains; then the oldest is taken out and replaced if the new one scores strictly more, for up to `extra` more turns
    or until m - 1 turns in a row bring nothing.
    """
    fixed, ways = fixed or [], list(start or [])
    if m <= len(fixed):
        raise ValueError("m must be above the number of fixed paths")
    counts = nodes.select("mer", F.col("cnt").cast("double").alias("cnt"))
    chains = contracted(edges) if chains is None else chains
    ways = ways[: m - len(fixed)]
    idle, score = 0, covered_score(counts, [*fixed, *ways])
    for _ in range(m - len(fixed) + extra):
        if idle and idle >= m - 1:
            break
        full = len(fixed) + len(ways) >= m
        out = ways.pop(0) if full else None
        known = F.broadcast(_table(counts, [*fixed, *ways]).withColumn("_known", F.lit(True)))
        left = counts.join(known, "mer", "left").select("mer", F.when(F.col("_known"), 0.0).otherwise(F.col("cnt")).alias("cnt"))
        _, path = best_path(left, edges, chains)
        new = covered_score(counts, [*fixed, *ways, path])
        if new > score:
            ways.append(path)
            score, idle = new, 0
        else:
            if out is not None:
                ways.append(out)
            idle += 1
    return score, [*fixed, *ways]


def path_table(spark: SparkSession, ways: list[list[str]]) -> DataFrame:
    """path_id, step, mer of a few ways, each as long as a sequence."""
    return spark.createDataFrame([(k, s, mer) for k, p in enumerate(ways) for s, mer in enumerate(p)], "path_id int, step int, mer string")


def complementary_paths(nodes: DataFrame, edges: DataFrame, m: int, fixed: list[list[str]] | None = None, extra: int = 0, start: list[list[str]] | None = None) -> DataFrame:
    """path_id, step, mer of complementary_ways()."""
    return path_table(nodes.sparkSession, complementary_ways(nodes, edges, m, fixed, extra, start)[1])


def random_way(edges: DataFrame, seed: str, start: str = BEGIN, stop: str = END, back: bool = False) -> list[str]:
    """The nodes between start and stop on a random way: every node has chosen one successor (with `back` one predecessor) by a hash, and the choices are followed."""
    near, far = ("dst", "src") if back else ("src", "dst")
    chosen = edges.groupBy(F.col(near).alias("mer")).agg(F.min_by(far, F.struct(F.xxhash64(F.lit(seed), "src", "dst"), far)).alias("to"))
    path = followed(chosen, start, stop)
    if path is None:
        raise ValueError(f"no way from {start} to {stop}")
    return path


def greedy_way(nodes: DataFrame, edges: DataFrame) -> list[str]:
    """The way from BEGIN to END by the successor of the largest count (ties by name)."""
    ranked = edges.join(nodes.select(F.col("mer").alias("dst"), "cnt"), "dst")
    chosen = ranked.groupBy(F.col("src").alias("mer")).agg(F.min(F.struct((-F.col("cnt")).alias("n"), "dst"))["dst"].alias("to"))
    path = followed(chosen, BEGIN, END)
    if path is None:
        raise ValueError("the best successors lead nowhere")
    return path


def half_kept_way(edges: DataFrame, path: list[str], seed: str) -> list[str]:
    """A way that keeps a random beginning or a random end of a path and goes a random way for the rest."""
    rng = random.Random(f"{seed}:half")
    k = rng.randrange(len(path))
    if rng.random() < 0.5:
        return [*path[: k + 1], *random_way(edges, seed, path[k], END)]
    return [*random_way(edges, seed, path[k], BEGIN, back=True)[::-1], *path[k:]]


def way_facts(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path_id, whole, first_score: for each path (path_id, step, mer) whether all its steps, with those from BEGIN and to END, are edges, and the score of path 0."""
    order = Window.partitionBy("path_id").orderBy("step")
    steps = paths.select("path_id", F.coalesce(F.lag("mer").over(order), F.lit(BEGIN)).alias("src"), F.col("mer").alias("dst"), F.lead("mer").over(order).isNull().alias("last"))
    steps = steps.select("path_id", "src", "dst").unionByName(steps.where("last").select("path_id", F.col("dst").alias("src"), F.lit(END).alias("dst")))
    known = steps.join(edges.select("src", "dst", F.lit(True).alias("known")), ["src", "dst"], "left")
    whole = known.groupBy("path_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("whole"))
    score = path_scores(nodes, paths.where("path_id = 0")).scalar()
    return whole.select("path_id", "whole", score.cast("bigint").alias("first_score"))


def back_steps(paths: DataFrame, placed: DataFrame) -> DataFrame:
    """path_id, most: the largest fall of level between two steps of each path."""
    at = paths.join(placed, "mer", "left")
    fall = F.lag("ppos").over(Window.partitionBy("path_id").orderBy("step")) - F.col("ppos")
    return at.withColumn("fall", fall).groupBy("path_id").agg(F.max("fall").alias("most"))


def paths_to_text(paths: DataFrame) -> DataFrame:
    """path_id, seq: the texts of the paths."""
    from merloom.functions.mers import mers_to_text

    ordered = paths.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "mer"))), lambda x: x["mer"]).alias("m"))
    return ordered.select("path_id", mers_to_text(F.col("m")).alias("seq"))
