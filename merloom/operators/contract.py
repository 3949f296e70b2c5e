"""Unbranched chains of a graph as single links, so that a search takes rounds by branches and not by nodes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merloom.storage import forget, written

#: Steps that one job takes: links that a search goes on, and jumps of a pointer.
HOPS = 4


class Chains(NamedTuple):
    """members: mer, chain, off of the nodes within chains (a chain has the name of its first node). links: src, dst, first, chain, steps, last between all other nodes: first is the node after src, last the one before dst, chain is null for a plain edge. rings: mer, low of the nodes on closed chains that no other edge touches; they are in no link."""

    members: DataFrame
    links: DataFrame
    rings: DataFrame


def contracted(edges: DataFrame, stops: DataFrame | None = None) -> Chains:
    """The chains of distinct edges (src, dst), by pointer jumping: as many rounds as the logarithm (to base HOPS) of the longest chain. Nodes in `stops` (mer) are not within chains."""
    out = edges.groupBy(F.col("src").alias("mer")).agg(F.count("*").alias("nout"), F.min("dst").alias("succ"))
    into = edges.groupBy(F.col("dst").alias("mer")).agg(F.count("*").alias("nin"), F.min("src").alias("pred"))
    inner = out.join(into, "mer").where("nin = 1 and nout = 1 and succ <> mer").select("mer", "pred", "succ")
    inner = written(inner.join(stops, "mer", "left_anti") if stops is not None else inner, "inner")
    known = inner.select(F.col("mer").alias("pred"), F.lit(True).alias("_inner"))
    at = inner.join(known, "pred", "left").select("mer", F.when(F.col("_inner"), F.col("pred")).otherwise(F.col("mer")).alias("up"), F.when(F.col("_inner"), 1).otherwise(0).cast("bigint").alias("off"), F.col("_inner").isNull().alias("found"), F.when(F.col("_inner"), F.least("mer", "pred")).otherwise(F.col("mer")).alias("low"))
    at, most, reach = written(at, "chain"), inner.count(), 1
    while reach <= 2 * most and not at.where("not found").isEmpty():
        far = at.select(F.col("mer").alias("up"), F.col("up").alias("up2"), F.col("off").alias("off2"), F.col("found").alias("found2"), F.col("low").alias("low2"))
        moved = at.where("not found")
        for _ in range(HOPS - 1):
            moved = moved.join(far, "up").select("mer", F.col("up2").alias("up"), (F.col("off") + F.col("off2")).alias("off"), F.col("found2").alias("found"), F.least("low", "low2").alias("low"))
        new = written(at.where("found").unionByName(moved), "chain")
        forget(at)
        at, reach = new, reach * HOPS
    members = at.where("found").select("mer", F.col("up").alias("chain"), "off")
    last = F.max(F.struct("off", "mer", "succ")).alias("e")
    ends = members.join(inner.select("mer", "succ"), "mer").groupBy("chain").agg(last).select(F.col("chain").alias("dst"), F.col("chain"), F.col("e.succ").alias("to"), F.col("e.mer").alias("last"), (F.col("e.off") + 2).alias("steps"))
    plain = edges.select("src", "dst").join(inner.select(F.col("mer").alias("src")), "src", "left_anti")
    links = plain.join(ends, "dst", "left").select("src", F.coalesce("to", "dst").alias("dst"), F.col("dst").alias("first"), "chain", F.coalesce("steps", F.lit(1)).cast("bigint").alias("steps"), F.coalesce("last", "src").alias("last"))
    return Chains(members, written(links, "links"), at.where("not found").select("mer", "low"))


def edges_of(edges: DataFrame, chains: Chains, kept: DataFrame) -> DataFrame:
    """The edges that the links `kept` stand for."""
    plain = edges.join(kept.select("src", F.col("first").alias("dst")), ["src", "dst"], "left_semi")
    alive = chains.members.join(kept.where("chain is not null").select("chain"), "chain", "left_semi").select(F.col("mer").alias("src"))
    return plain.select(*edges.columns).unionByName(edges.join(alive, "src", "left_semi").select(*edges.columns))


def steps_from(links: DataFrame, start: DataFrame, group: list[str] | None = None) -> DataFrame:
    """mer, ppos: the least number of steps to each node that `start` (mer, ppos) reaches over the links; relaxed in rounds over the links whose source changed. With `group` both tables have these columns too, and each group is searched by itself."""
    own = group or []
    keys = [*own, "mer"]
    values = changed = written(start.select(*keys, F.col("ppos").cast("bigint").alias("ppos")), "reached")
    ways = links.select(*own, F.col("src").alias("mer"), "dst", F.col("steps").cast("bigint").alias("steps"))
    # a way of no step from each node to itself, so that HOPS joins go on up to HOPS links
    stay = links.select(*own, F.explode(F.array("src", "dst")).alias("mer")).unionByName(start.select(*keys)).distinct()
    ways = written(ways.unionByName(stay.select(*own, "mer", F.col("mer").alias("dst"), F.lit(0).cast("bigint").alias("steps"))), "ways")
    while True:
        offers = changed
        for _ in range(HOPS):
            offers = ways.join(offers, keys).groupBy(*own, F.col("dst").alias("mer")).agg(F.min(F.col("ppos") + F.col("steps")).alias("ppos"))
        both = offers.withColumnRenamed("ppos", "new").join(values.withColumnRenamed("ppos", "old"), keys, "full")
        new = written(both.select(*keys, F.least("new", "old").alias("ppos"), (F.col("old").isNull() | (F.col("new") < F.col("old"))).alias("better")), "reached")
        forget(values)
        values, changed = new.drop("better"), new.where("better").drop("better")
        values._written_to = new._written_to
        if changed.isEmpty():
            forget(ways)
            return values


def inner_steps(chains: Chains, values: DataFrame) -> DataFrame:
    """mer, ppos of the nodes within chains whose source has a value."""
    heads = chains.links.where("chain is not null").join(values.withColumnRenamed("mer", "src"), "src").select("chain", "ppos")
    return chains.members.join(heads, "chain").select("mer", (F.col("ppos") + F.col("off") + 1).alias("ppos"))


def followed(pointers: DataFrame, start: str, stop: str) -> list[str] | None:
    """The nodes from start to stop (both left out) along pointers (mer, to), one for each node; none if the way ends elsewhere or never.

    Pointers are doubled, so there are as many rounds as the logarithm of the way; the way, as long as one sequence,
    comes to the driver.
    """
    spark = pointers.sparkSession
    jump = written(pointers.select("mer", "to"), "jump")
    way = written(spark.range(1).select(F.lit(start).alias("mer"), F.lit(0).cast("bigint").alias("n")), "way")
    most, reach = jump.count(), 1
    while True:
        more = way.join(jump, "mer").select(F.col("to").alias("mer"), (F.col("n") + reach).alias("n"))
        new = written(way.unionByName(more), "way")
        forget(way)
        way = new
        end = way.where(F.col("mer") == stop).agg(F.min("n")).first()[0]
        if end is not None:
            path = [r["mer"] for r in way.where(F.col("n") < end).where("n > 0").orderBy("n").collect()]
            forget(way, jump)
            return path
        if reach > most:
            forget(way, jump)
            return None
        far = jump.select(F.col("mer").alias("to"), F.col("to").alias("to2"))
        new = written(jump.join(far, "to").select("mer", F.col("to2").alias("to")), "jump")
        forget(jump)
        jump, reach = new, 2 * reach


