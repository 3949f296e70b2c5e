"""The de Bruijn graph of mers as two tables: nodes (mer, cnt) and edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merloom.operators.contract import contracted, edges_of, inner_steps, steps_from
from merloom.operators.tally import end_mers
from merloom.storage import forget, written

#: The names of the nodes before all first and after all last mers; no mer looks like them.
BEGIN, END = "==BEGIN==", "===END==="
#: Rounds of trimming after which chains are contracted anew.
TRIMMED = 8


def nodes_above(tally: DataFrame, low: float = 0) -> DataFrame:
    """Mers with a count above `low`; 0 keeps all."""
    return tally.where(F.col("cnt") > low) if low else tally


def overlaps(nodes: DataFrame, e: int) -> DataFrame:
    """src, dst of mers where the tail of one is the head of the other; none with itself."""
    a = nodes.select(F.col("mer").alias("src"), F.substring("mer", 2, e - 1).alias("_k"))
    b = nodes.select(F.col("mer").alias("dst"), F.substring("mer", 1, e - 1).alias("_k"))
    return a.join(b, "_k").where("src <> dst").select("src", "dst")


def build(tally: DataFrame, ends: DataFrame, e: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with BEGIN and END (count 0), and edges: overlaps, BEGIN to first mers, last mers to END. Where no first (last) mer is a node, all nodes without predecessor (successor) take their place."""
    spark = tally.sparkSession
    inner = overlaps(tally, e)
    known = ends.join(tally, "mer", "left_semi")
    firsts, lasts = known.where("is_first").select("mer"), known.where("is_last").select("mer")
    if firsts.isEmpty():
        firsts = tally.select("mer").join(inner.select(F.col("dst").alias("mer")), "mer", "left_anti")
    if lasts.isEmpty():
        lasts = tally.select("mer").join(inner.select(F.col("src").alias("mer")), "mer", "left_anti")
    edges = inner.unionByName(firsts.select(F.lit(BEGIN).alias("src"), F.col("mer").alias("dst"))).unionByName(lasts.select(F.col("mer").alias("src"), F.lit(END).alias("dst")))
    kind = tally.schema["cnt"].dataType
    both = spark.range(2).select(F.when(F.col("id") == 0, BEGIN).otherwise(END).alias("mer"), F.lit(0).cast(kind).alias("cnt"))
    return tally.select("mer", "cnt").unionByName(both), edges


def from_rows(df: DataFrame, tally: DataFrame, e: int, low: float = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and total (the sum of counts before low ones were dropped)."""
    kept = nodes_above(tally, low)
    return *build(kept, end_mers(df, e), e), tally.agg(F.sum("cnt").alias("total"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """mer, cnt, nin, nout, pred, succ: pred and succ are the smallest neighbours."""
    out = edges.groupBy(F.col("src").alias("mer")).agg(F.count("*").alias("nout"), F.min("dst").alias("succ"))
    into = edges.groupBy(F.col("dst").alias("mer")).agg(F.count("*").alias("nin"), F.min("src").alias("pred"))
    return nodes.join(out, "mer", "left").join(into, "mer", "left").na.fill(0, ["nin", "nout"])


def low_edges(nodes: DataFrame, edges: DataFrame, low: float) -> DataFrame:
    """Edges both of whose ends have a count of at most `low` (BEGIN and END have 0)."""
    a, b = nodes.select(F.col("mer").alias("src"), F.col("cnt").alias("ca")), nodes.select(F.col("mer").alias("dst"), F.col("cnt").alias("cb"))
    return edges.join(a, "src").join(b, "dst").where((F.col("ca") <= low) & (F.col("cb") <= low)).select("src", "dst")


def weak_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with a count of at most 1 and one predecessor and one successor, both with a count of at most 1."""
    d = degrees(nodes, edges).where(~F.col("mer").isin(BEGIN, END)).where("cnt <= 1 and nin = 1 and nout = 1")
    counts = nodes.select("mer", "cnt")
    d = d.select("mer", "pred", "succ").join(counts.select(F.col("mer").alias("pred"), F.col("cnt").alias("cp")), "pred").join(counts.select(F.col("mer").alias("succ"), F.col("cnt").alias("cs")), "succ")
    return d.where("cp <= 1 and cs <= 1").select("mer")


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes `gone`."""
    return edges.join(gone.select(F.col("mer").alias("src")), "src", "left_anti").join(gone.select(F.col("mer").alias("dst")), "dst", "left_anti").select("src", "dst")


def _trimmed(edges: DataFrame, near: str, far: str, stop: str) -> DataFrame:
    """Edges left when nodes that are never a `near` end (but for `stop`) go, again and again. Whole chains go at once; what was branched before is contracted again after some rounds."""
    while True:
        chains = contracted(edges)
        links, rounds, first = chains.links, 0, True
        have = links.count()
        while rounds < TRIMMED:
            alive = links.select(F.col(near).alias(far)).distinct()
            new = written(links.join(alive, far, "left_semi").unionByName(links.where(F.col(far) == stop).join(alive, far, "left_anti")).select(*links.columns), "trim")
            if not first:
                forget(links)
            links, left, first, rounds = new, new.count(), False, rounds + 1
            if left == have:
                break
            have = left
        # closed chains keep themselves alive
        ring = edges.join(chains.rings.select(F.col("mer").alias("src")), "src", "left_semi").select(*edges.columns)
        edges = written(edges_of(edges, chains, links).unionByName(ring), "trimmed")
        if rounds < TRIMMED:
            return edges


def without_dead_ends(edges: DataFrame) -> DataFrame:
    """Edges on the way to END: nodes without a successor go, again and again."""
    return _trimmed(edges, "src", "dst", END)


def without_dead_begins(edges: DataFrame) -> DataFrame:
    return _trimmed(edges, "dst", "src", BEGIN)


def levels(edges: DataFrame, root: str = BEGIN) -> DataFrame:
    """mer, ppos: the least number of steps from the root to each node it reaches. Searched over the links between branches; as many rounds as the best ways have links."""
    start = edges.sparkSession.range(1).select(F.lit(root).alias("mer"))
    chains = contracted(edges, start)
    values = steps_from(chains.links, start.withColumn("ppos", F.lit(0)))
    return written(values.unionByName(inner_steps(chains, values)).select("mer", F.col("ppos").cast("int").alias("ppos")), "levels")


def forward(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """The edges that lead up a level, and those to END: an acyclic graph in which each node is reached as early as before."""
    a, b = placed.select(F.col("mer").alias("src"), F.col("ppos").alias("_a")), placed.select(F.col("mer").alias("dst"), F.col("ppos").alias("_b"))
    return edges.join(a, "src").join(b, "dst").where((F.col("_b") > F.col("_a")) | (F.col("dst") == END)).select("src", "dst")


def reaches_end(edges: DataFrame) -> bool:
    return not levels(edges).where(F.col("mer") == END).isEmpty()


def reachable(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges whose nodes the root reaches."""
    return edges.join(placed.select(F.col("mer").alias("src")), "src", "left_semi").select("src", "dst")


def cleaned(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges on a way from BEGIN to END, and the levels of their nodes; an error if there is no such way."""
    edges = without_dead_begins(without_dead_ends(edges))
    placed = levels(edges)
    if placed.where(F.col("mer") == END).isEmpty():
        raise ValueError("END can't be reached from BEGIN")
    return written(reachable(edges, placed), "clean"), placed


def cut_back_links(edges: DataFrame, placed: DataFrame, most: int) -> DataFrame:
    """Edges that fall back more than `most` levels lead to END instead."""
    a, b = placed.select(F.col("mer").alias("src"), F.col("ppos").alias("pa")), placed.select(F.col("mer").alias("dst"), F.col("ppos").alias("pb"))
    far = (F.col("dst") != END) & (F.col("pa") - F.col("pb") > most)
    return edges.join(a, "src", "left").join(b, "dst", "left").select("src", F.when(far, END).otherwise(F.col("dst")).alias("dst")).distinct()


def _flag(c: Column) -> Column:
    return c.cast("int")


def _costs() -> dict[str, Column]:
    ca, cb = F.col("ca"), F.col("cb")
    spouse, sibling = _flag(F.col("nin_b") == 1), _flag(F.col("nout_a") == 1)
    both, high = ca + cb, F.greatest(ca, cb)
    iso = ca * _flag(F.col("nin_a") == 1) + cb * _flag(F.col("nout_b") == 1)
    return {
        "rss": both + cb * spouse + ca * sibling,
        "rs2": both + 2 * cb * spouse + 2 * ca * sibling,
        "sum": both,
        "sup": high,
        "iso": iso,
        "supiso": high + iso,
        "sso": high + iso,
        "sib": both + ca * sibling,
        "sps": both + cb * spouse,
        "rnd": ca * 0,
        "pos": F.coalesce(-F.col("pa"), F.lit(0)),
        "dpos": F.coalesce(F.col("pb") - F.col("pa"), F.lit(0)),
    }


def edge_costs(nodes: DataFrame, edges: DataFrame, placed: DataFrame, names: list[str] | None = None) -> DataFrame:
    """src, dst and a column for each named cost; an unknown name means rss."""
    d = degrees(nodes, edges).join(placed, "mer", "left")
    a, b = (d.select(F.col("mer").alias(end), F.col("cnt").alias(f"c{x}"), F.col("nin").alias(f"nin_{x}"), F.col("nout").alias(f"nout_{x}"), F.col("ppos").alias(f"p{x}")) for end, x in (("src", "a"), ("dst", "b")))
    return costs_of(edges.join(a, "src").join(b, "dst"), names)


def costs_of(ends: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The costs of edges with the counts, degrees and levels of both ends: ca, cb, nin_a, nout_a, nin_b, nout_b, pa, pb."""
    table = _costs()
    return ends.select("src", "dst", *(table.get(n, table["rss"]).alias(n) for n in names or list(table)))


def write_graph(path: str, nodes: DataFrame, edges: DataFrame, e: int, reverse: bool = False) -> None:
    """nodes/, edges/ and meta/ as Parquet."""
    nodes.write.mode("errorifexists").parquet(f"{path}/nodes")
    edges.write.mode("errorifexists").parquet(f"{path}/edges")
    nodes.sparkSession.range(1).select(F.lit(e).alias("e"), F.lit(reverse).alias("reverse")).write.parquet(f"{path}/meta")


def read_graph(spark, path: str, e: int, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """The tables written by write_graph(); an error if they were made for another mer length or direction."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if (meta["e"], meta["reverse"]) != (e, reverse):
        raise ValueError(f"the graph has e={meta['e']}, reverse={meta['reverse']}")
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
