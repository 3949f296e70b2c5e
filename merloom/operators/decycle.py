"""Removing the cycles of a mer graph at little cost.

Unbranched chains are contracted first: a chain is on a cycle as a whole, and its cheapest edge stands for it. Cycles lie
within strongly connected parts, which are found on the cluster by labels that spread along and against the links. Parts
are worked on side by side, each in one task; a part with more links than a task takes is cut on the cluster by its
levels before that, again and again, where the links that lead back over the cut cost least. Only edges on a cycle go.
"""

from __future__ import annotations

import heapq
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merloom.operators.contract import HOPS, contracted, edges_of, steps_from
from merloom.storage import forget, written

#: Links of a strongly connected part that one task takes; larger parts are cut first.
TASK_LINKS = 4_000
#: Rounds of peeling before labels are spread; more only make the parts smaller.
PEELED = 2
#: Levels at which a large part may be cut: these shares of its nodes lie below.
CUTS = [k / 16 for k in range(4, 13)]


def cyclic_core(edges: DataFrame, rounds: int = PEELED) -> DataFrame:
    """Edges left after at most `rounds` rounds without the nodes that have no predecessor or no successor; all edges of cycles are among them."""
    have, first = edges.count(), edges
    for _ in range(rounds):
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        new = written(kept.select(*edges.columns), "core")
        if edges is not first:
            forget(edges)
        edges, left = new, new.count()
        if left == have:
            break
        have = left
    return edges


def _first_name(edges: DataFrame, near: str, far: str, turn: int) -> DataFrame:
    """mer, label: of all nodes that reach a node from `near` to `far` (itself among them) the first in an order by hash, by rounds of HOPS steps and a jump to the label's own label."""
    name = F.concat(F.lpad(F.hex(F.xxhash64("mer", F.lit(turn))), 16, "0"), F.col("mer"))
    nodes = edges.select(F.explode(F.array(near, far)).alias("mer")).distinct()
    # with a step from each node to itself a step never loses a label
    pairs = written(edges.select(F.col(near).alias("mer"), F.col(far).alias("to")).distinct().unionByName(nodes.select("mer", F.col("mer").alias("to"))), "pairs")
    labels = written(nodes.select("mer", name.alias("label")), "first")
    while True:
        now = labels
        for _ in range(HOPS):
            now = pairs.join(now, "mer").groupBy(F.col("to").alias("mer")).agg(F.min("label").alias("label"))
        # what reaches the node of the label reaches this node too
        best = labels.select(F.col("mer").alias("_root"), F.col("label").alias("best"))
        now = now.withColumn("_root", F.substring("label", 17, 1 << 20)).join(best, "_root").join(labels.withColumnRenamed("label", "old"), "mer")
        new = written(now.select("mer", F.least("label", "best").alias("label"), "old"), "first")
        forget(labels)
        labels = new.select("mer", "label")
        labels._written_to = new._written_to
        if new.where("old <> label").isEmpty():
            forget(pairs)
            return labels


def strong_edges(edges: DataFrame) -> DataFrame:
    """The edges within strongly connected parts, all columns and `part`, the same for all edges of a part; edges from a node to itself are no part.

    Labels spread along the edges, then against those that are left: nodes of one part are reached by the same nodes and
    reach the same nodes, so edges between different labels go. Where both labels are one node's, it reaches all nodes of
    the part and is reached by them; the rest takes another turn.
    """
    names, turn, done = [c for c in edges.columns if c != "part"], 0, []
    left = written(edges.where("src <> dst").select(*names), "strong")
    while not left.isEmpty():
        turn += 1
        held, left = left, cyclic_core(left)
        for near, far, name in (("src", "dst", "part"), ("dst", "src", "_back")):
            labels = _first_name(left, near, far, turn)
            a, b = (labels.select(F.col("mer").alias(end), F.col("label").alias(x)) for end, x in (("src", name), ("dst", "_b")))
            left = written(left.join(a, "src").join(b, "dst").where(F.col(name) == F.col("_b")).drop("_b"), "strong")
            forget(labels)
        forget(held)
        done.append(left.where("part = _back").select(*names, "part"))
        left = left.where("part <> _back").select(*names)
    found = edges.select(*names, F.lit("").alias("part")).limit(0)
    for part in done:
        found = found.unionByName(part)
    return found


def strong_parts(after: dict[str, set[str]]) -> list[list[str]]:
    """Strongly connected sets of more than one node: nodes by finishing time, then searches against the edges."""
    seen: set[str] = set()
    order: list[str] = []
    for root in sorted(after):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(sorted(after[root])))]
        while stack:
            node, rest = stack[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(sorted(after.get(step, ())))))
    before: dict[str, set[str]] = {}
    for a, bs in after.items():
        for b in bs:
            before.setdefault(b, set()).add(a)
    parts, taken = [], set()
    for root in reversed(order):
        if root in taken:
            continue
        part, todo = [], [root]
        taken.add(root)
        while todo:
            part.append(x := todo.pop())
            todo += (new := before.get(x, set()) - taken)
            taken |= new
        if len(part) > 1:
            parts.append(sorted(part))
    return parts


#: The links out of each node: (steps, dst, cost of the cheapest edge, its src, its dst).
Links = dict[str, list[tuple]]


def shortest_cycle(after: Links, start: str, inside: set[str]) -> list[tuple[str, tuple]] | None:
    """The links (node, link) of a shortest cycle through `start`, or none."""
    came: dict[str, tuple[str, tuple]] = {}
    todo = [(0, start)]
    done: set[str] = set()
    best = {start: 0}
    while todo:
        far, node = heapq.heappop(todo)
        if node in done and node != start:
            continue
        if node == start and far:
            back = []
            while True:
                back.append(came[node])
                node = back[-1][0]
                if node == start:
                    return back[::-1]
        done.add(node)
        for link in after[node]:
            x, n = link[1], far + link[0]
            if x in inside and (x == start and (not best[start] or n < best[start]) or x not in best or n < best[x]):
                best[x] = n
                came[x] = (node, link)
                heapq.heappush(todo, (n, x))
    return None


def _broken(part: pd.DataFrame, seed: int) -> pd.DataFrame:
    """The edges to remove from one part, given as links with their cheapest edges; costs stay as they were at first. The random choices depend on the part alone."""
    after: Links = {}
    for a, b, n, c, x, y in zip(*(part[k] for k in ("src", "dst", "steps", "cost", "low_src", "low_dst")), strict=True):
        after.setdefault(a, []).append((n, b, c, x, y))
        after.setdefault(b, [])
    gone = []
    while parts := strong_parts({a: {k[1] for k in ks} for a, ks in after.items()}):
        for nodes in parts:
            inside, rng = set(nodes), random.Random(f"{seed}:{nodes[0]}")
            while (cycle := shortest_cycle(after, rng.choice(nodes), inside)) is not None:
                node, link = min(cycle, key=lambda k: k[1][2:])
                after[node].remove(link)
                gone.append(link[2:])
    return pd.DataFrame({"src": [x for _, x, _ in gone], "dst": [y for _, _, y in gone], "cost": [float(c) for c, _, _ in gone]})


def _cut(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the links of large parts: those that go, so that each part falls apart, and the others. A part is levelled from its first node; of some cuts near the middle the one whose links back cost least is taken."""
    roots = large.groupBy("part").agg(F.min("src").alias("mer")).withColumn("ppos", F.lit(0))
    placed = steps_from(large, roots, ["part"])
    at = placed.groupBy("part").agg(F.array_distinct(F.percentile_approx("ppos", CUTS, 1000)).alias("cuts"), F.max("ppos").alias("top"))
    # a cut above all levels would cut nothing
    at = at.select("part", F.explode(F.array_distinct(F.transform("cuts", lambda c: F.least(c, F.col("top") - 1)))).alias("cut"))
    a, b = (placed.select("part", F.col("mer").alias(end), F.col("ppos").alias(x)) for end, x in (("src", "_a"), ("dst", "_b")))
    levelled = written(large.join(a, ["part", "src"]).join(b, ["part", "dst"]), "levelled")
    over = levelled.where("_a > _b").join(F.broadcast(at), "part").where("_a > cut and _b <= cut")
    costs = over.groupBy("part", "cut").agg(F.sum("cost").alias("c"), F.count("*").alias("n"))
    chosen = costs.groupBy("part").agg(F.min(F.struct("c", "n", "cut"))["cut"].alias("cut"))
    marked = written(levelled.join(F.broadcast(chosen), "part", "left").withColumn("_out", F.coalesce((F.col("_a") > F.col("cut")) & (F.col("_b") <= F.col("cut")), F.lit(False))), "marked")
    forget(levelled, placed)
    return marked.where("_out").select(*large.columns), marked.where("not _out").select(*large.columns)


def removed_edges(costed: DataFrame, seed: int = 1, task_links: int = TASK_LINKS) -> DataFrame:
    """src, dst, cost of the edges to remove from distinct (src, dst, cost) so that no cycle is left; a written table.

    In each strongly connected part: a node at random, a shortest cycle through it, its cheapest edge goes (ties by
    name), until the node is on no cycle; again while a part is left. A part of more than `task_links` links (unbranched
    chains count as one) is first cut in two on the cluster, by removing the links back over a cut of its levels, until
    its parts are small enough. An edge from a node to itself goes. An empty table, or one without cycles, gives no rows.
    """
    edges = written(costed.select("src", "dst", F.col("cost").cast("double").alias("cost")), "costed")
    loops = edges.where("src = dst")
    edges = edges.where("src <> dst")
    chains = contracted(edges.select("src", "dst"))
    # each edge belongs to one link: its chain's, or its own
    owned = edges.join(chains.members.select(F.col("mer").alias("src"), F.col("chain").alias("_c")), "src", "left")
    inside = owned.where("_c is not null").groupBy(F.col("_c").alias("chain")).agg(F.min(F.struct("cost", "src", "dst")).alias("e"))
    entry = chains.links.join(edges.select("src", F.col("dst").alias("first"), "cost"), ["src", "first"]).join(inside, "chain", "left")
    low = F.least(F.struct("cost", "src", F.col("first").alias("dst")), F.coalesce("e", F.struct("cost", "src", F.col("first").alias("dst"))))
    links = written(entry.select("src", "dst", "steps", low.alias("low")).select("src", "dst", "steps", "low.cost", F.col("low.src").alias("low_src"), F.col("low.dst").alias("low_dst")), "links")
    rings = edges.join(chains.rings.withColumnRenamed("mer", "src"), "src").groupBy("low").agg(F.min(F.struct("cost", "src", "dst")).alias("e")).select("e.*")
    gone = [loops, rings, links.where("src = dst").select(F.col("low_src").alias("src"), F.col("low_dst").alias("dst"), "cost")]
    left, small = links.where("src <> dst"), []
    while True:
        parts = written(strong_edges(left), "parts")
        sizes = written(parts.groupBy("part").count().where(F.col("count") > task_links).select("part"), "large")
        small.append(parts.join(sizes, "part", "left_anti"))
        if sizes.isEmpty():
            break
        out, left = _cut(written(parts.join(sizes, "part", "left_semi"), "large"))
        gone.append(out.select(F.col("low_src").alias("src"), F.col("low_dst").alias("dst"), "cost"))
    for part in small:
        gone.append(part.groupBy("part").applyInPandas(lambda rows: _broken(rows, seed), "src string, dst string, cost double"))
    found = gone[0].select("src", "dst", "cost")
    for g in gone[1:]:
        found = found.unionByName(g.select("src", "dst", "cost"))
    return written(found, "gone")


def decycled(edges: DataFrame, costed: DataFrame, seed: int = 1) -> DataFrame:
    """The edges without those that removed_edges() names."""
    return edges.join(removed_edges(costed, seed).select("src", "dst"), ["src", "dst"], "left_anti")


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """The distinct edges (src, dst) that are on a cycle."""
    edges = written(edges.select("src", "dst"), "edges")
    chains = contracted(edges.where("src <> dst"))
    parts = strong_edges(chains.links).select(*chains.links.columns)
    kept = written(parts.unionByName(chains.links.where("src = dst")), "kept")
    rings = edges.join(chains.rings.select(F.col("mer").alias("src")), "src", "left_semi").select("src", "dst")
    return edges_of(edges, chains, kept).unionByName(rings).unionByName(edges.where("src = dst"))


def removal_facts(costed: DataFrame, seed: int = 1) -> DataFrame:
    """edges, left_on_cycles, some_removed: how many edges there were, how many are on a cycle after the removal, and whether any went."""
    gone = removed_edges(costed, seed).select("src", "dst")
    after = cyclic_edges(costed.join(gone, ["src", "dst"], "left_anti"))
    facts = costed.agg(F.count("*").alias("edges")).join(after.agg(F.count("*").alias("left_on_cycles")))
    return facts.join(gone.agg((F.count("*") > 0).alias("some_removed")))
