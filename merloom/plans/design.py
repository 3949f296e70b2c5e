"""The whole design: from a population to m complementary sequences."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merloom.functions.mers import mers
from merloom.operators import decycle, filters, graph, paths, tally
from merloom.operators.contract import contracted
from merloom.storage import written


@dataclass
class Design:
    """Parameters: mer length, number of sequences, counts that are too low, edge cost, how filters and turns work, and sequences to start with: fixed ones stay, hints may be replaced; names go to the first results."""

    e: int = 9
    m: int = 3
    low_nodes: float = 0
    low_edges: float = 0
    drop_weak: bool = False
    cost: str = "rss"
    extra: int = 0
    trials: int = 1
    reverse: bool = False
    tmr: int = 0
    span: tuple[int, int] | None = None
    seed: int = 1
    fixed: list[str] = field(default_factory=list)
    hints: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def design_graph(population: DataFrame, p: Design, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame, float]:
    """nodes, edges and total count of the acyclic graph; a step that would cut END off is not taken."""
    rows = filters.design_filter(population, p.e, p.reverse, p.tmr, p.span)
    counts = written(tally.mer_tally(rows, p.e) if weights is None else tally.weighted_tally(rows, weights, p.e), "tally")
    nodes, edges, total = graph.from_rows(rows, counts, p.e, p.low_nodes)
    nodes, edges, total = written(nodes, "nodes"), written(edges, "edges"), total.first()[0]
    if not total:
        raise ValueError("the population holds no mer")
    if p.drop_weak:
        less = written(graph.without(edges, graph.weak_nodes(nodes, edges)), "strong")
        edges = less if graph.reaches_end(less) else edges
    if p.low_edges:
        less = written(edges.join(graph.low_edges(nodes, edges, p.low_edges), ["src", "dst"], "left_anti"), "high")
        edges = less if graph.reaches_end(less) else edges
    edges, placed = graph.cleaned(edges)
    costs = graph.edge_costs(nodes, edges, placed, [p.cost]).withColumnRenamed(p.cost, "cost")
    edges, placed = graph.cleaned(written(decycle.decycled(edges, costs, p.seed), "acyclic"))
    return written(nodes.join(placed.select("mer"), "mer", "left_semi"), "nodes"), edges, float(total)


def _ways(population: DataFrame, texts: list[str], p: Design) -> list[list[str]]:
    """The mers of given texts in order."""
    if not texts:
        return []
    seq = F.reverse("s") if p.reverse else F.col("s")
    rows = population.sparkSession.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", mers(seq, p.e).alias("m"))
    return [r["m"] for r in rows.orderBy("i").collect()]


def design_trials(population: DataFrame, p: Design, weights: DataFrame | None = None) -> tuple[float, list[float], list[list[str]]]:
    """The total of counts, the score of each trial, and the ways of the best.

    Trial 0 starts with the hints. Later odd trials start with a random way, even ones with a random one of the best
    ways so far, of which a random part is kept and the rest goes a random way; all by the seed. A trial's ways count
    only if they score strictly more than the best before.
    """
    if p.m == 1 and p.trials > 1:
        raise ValueError("several trials need m above 1")
    nodes, edges, total = design_graph(population, p, weights)
    fixed, hints = _ways(population, p.fixed, p), _ways(population, p.hints, p)
    chains, scores, best = contracted(edges), [], []
    rng = random.Random(f"{p.seed}:trials")
    for trial in range(p.trials):
        seed = f"{p.seed}:{trial}"
        free = [w for w in best[len(fixed) :] if w]
        if not trial:
            start = hints
        elif trial % 2 or not free:
            start = [paths.random_way(edges, seed)]
        else:
            # what starts with a hint may leave the graph, so only its nodes are gone on from
            start = [paths.half_kept_way(edges, on, seed)] if (on := _inside(edges, rng.choice(free))) else [paths.random_way(edges, seed)]
        score, ways = paths.complementary_ways(nodes, edges, p.m, fixed, p.extra, start, chains)
        if not scores or score > max(scores):
            best = ways
        scores.append(score)
    return total, scores, best


def _inside(edges: DataFrame, way: list[str]) -> list[str]:
    """The way if all its steps are edges, else nothing."""
    steps = list(zip([graph.BEGIN, *way], [*way, graph.END], strict=True))
    known = edges.join(F.broadcast(edges.sparkSession.createDataFrame(sorted(set(steps)), "src string, dst string")), ["src", "dst"], "left_semi").count()
    return way if known == len(set(steps)) else []


def design(population: DataFrame, p: Design, weights: DataFrame | None = None) -> DataFrame:
    """path_id, name, seq, share: the designed sequences and the share of all counts that they cover together.

    `fixed` sequences come first and stay. The best of p.trials trials wins, see design_trials(). Names are those given,
    in order, then EG-k. There may be fewer than m sequences, if no other way gains.
    """
    total, scores, ways = design_trials(population, p, weights)
    spark = population.sparkSession
    text = paths.paths_to_text(paths.path_table(spark, ways))
    text = text.withColumn("seq", F.reverse("seq")) if p.reverse else text
    given = F.array(*map(F.lit, p.names)).cast("array<string>")
    name = F.coalesce(F.get(given, F.col("path_id")), F.concat(F.lit("EG-"), F.col("path_id").cast("string")))
    return text.select("path_id", name.alias("name"), "seq", F.lit(max(scores) / total).alias("share"))

