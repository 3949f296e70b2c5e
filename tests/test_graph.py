import random

import pandas as pd
import pytest
from conftest import rows

from merloom.operators import contract, decycle, graph, paths, tally


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Tiny tables and many jobs: one task a stage."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_small_graph(spark):
    df = spark.createDataFrame([(0, "n", "ABCDE"), (1, "m", "ABCXE")], "ord bigint, name string, seq string")
    nodes, edges, total = graph.from_rows(df, tally.mer_tally(df, 3), 3)
    assert total.first()[0] == 6
    assert (graph.BEGIN, "ABC") in rows(edges) and ("CDE", graph.END) in rows(edges) and ("ABC", "BCD") in rows(edges)
    levels = dict(rows(graph.levels(edges)))
    assert levels["ABC"] == 1 and levels[graph.END] == 4
    score, path = paths.best_path(nodes, edges)
    assert score == 4 and path == ["ABC", "BCD", "CDE"]


def test_dead_parts_go(spark):
    b, e = graph.BEGIN, graph.END
    edges = _edges(spark, [(b, "a"), ("a", "b"), ("b", e), ("a", "x"), ("x", "y"), ("u", "a"), ("v", "u"), ("p", "q"), ("q", "p")])
    kept, placed = graph.cleaned(edges)
    assert rows(kept) == sorted([(b, "a"), ("a", "b"), ("b", e)], key=repr)


def test_best_value_is_brute_force(spark):
    rng = random.Random(4)
    names = [f"n{i:02d}" for i in range(12)]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.3]
    pairs += [(graph.BEGIN, n) for n in names[:3]] + [(n, graph.END) for n in names[-3:]]
    counts = {n: rng.randrange(1, 9) for n in names} | {graph.BEGIN: 0, graph.END: 0}
    after = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)

    def best(n):
        return 0 if n == graph.END else max((counts[m] + best(m) for m in after.get(n, []) if best(m) > float("-inf")), default=float("-inf"))

    nodes = spark.createDataFrame(list(counts.items()), "mer string, cnt bigint")
    score, path = paths.best_path(nodes, _edges(spark, pairs))
    assert score == best(graph.BEGIN)
    steps = [graph.BEGIN, *path, graph.END]
    assert all(p in set(pairs) for p in zip(steps[:-1], steps[1:], strict=True))


def _acyclic(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    return not decycle.strong_parts({**{b: set() for _, b in pairs}, **after})


def test_no_cycle_is_left(spark):
    rng = random.Random(2)
    pairs = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(120)})
    pairs = [(a, b) for a, b in pairs if a != b]
    costed = spark.createDataFrame([(a, b, float(rng.randrange(9))) for a, b in pairs], "src string, dst string, cost double")
    assert not _acyclic(pairs)
    on_cycle = set(rows(decycle.cyclic_edges(costed)))
    gone = {(r["src"], r["dst"]) for r in decycle.removed_edges(costed, task_links=15).collect()}
    assert gone and gone <= on_cycle and _acyclic([p for p in pairs if p not in gone])
    part = costed.selectExpr("src", "dst", "1 AS steps", "cost", "src AS low_src", "dst AS low_dst").toPandas()
    small = {(a, b) for a, b, _ in decycle._broken(part, 1).itertuples(index=False)}
    assert small <= on_cycle and _acyclic([p for p in pairs if p not in small])


def test_acyclic_graph_loses_nothing(spark):
    costed = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 0.0)], "src string, dst string, cost double")
    assert decycle.removed_edges(costed).count() == 0


def test_large_acyclic_graph_loses_nothing(spark):
    """Long ways outlast the peeling, and all costs are tied."""
    costed = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}", 0.0) for i in range(9) for j in (i + 1, i + 2)], "src string, dst string, cost double")
    assert decycle.removed_edges(costed, task_links=5).count() == 0


def test_strong_edges_are_those_of_the_search(spark):
    rng = random.Random(6)
    pairs = sorted({(f"n{rng.randrange(20)}", f"n{rng.randrange(20)}") for _ in range(28)})
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    part = {x: k for k, nodes in enumerate(decycle.strong_parts(after)) for x in nodes}
    pairs = [(a, b) for a, b in pairs if a != b]
    want = sorted((a, b) for a, b in pairs if a in part and part[a] == part.get(b))
    assert want and rows(decycle.strong_edges(_edges(spark, pairs)).select("src", "dst")) == want


def test_rings_and_loops(spark):
    """Closed chains, with and without a way in, an edge from a node to itself, and a chain from a node back to it."""
    pairs = [("a", "b", 3.0), ("b", "c", 1.0), ("c", "a", 2.0), ("p", "q", 2.0), ("q", "p", 5.0), ("x", "p", 0.0), ("s", "s", 1.0), ("m", "n", 4.0), ("n", "m", 3.0), ("m", "z", 0.0)]
    costed = spark.createDataFrame(pairs, "src string, dst string, cost double")
    assert rows(decycle.removed_edges(costed)) == [("b", "c", 1.0), ("n", "m", 3.0), ("p", "q", 2.0), ("s", "s", 1.0)]
    assert len(rows(decycle.cyclic_edges(costed))) == 8


def test_chains(spark):
    """A long chain, a ring, a branch: members in order, and links that stand for all edges."""
    pairs = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)] + [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("c000", "d"), ("d", "c040"), ("c040", "e")]
    edges = _edges(spark, pairs)
    chains = contract.contracted(edges)
    assert [m for m, _, _ in sorted(rows(chains.members.where("chain = 'c001'")), key=lambda r: r[2])] == [f"c{i:03d}" for i in range(1, 40)]
    assert rows(chains.links.select("src", "dst", "steps")) == [("c000", "c040", 2), ("c000", "c040", 40), ("c040", "e", 1)]
    assert {(r["mer"], r["low"]) for r in chains.rings.collect()} == {("r0", "r0"), ("r1", "r0"), ("r2", "r0")}
    kept = contract.edges_of(edges, chains, chains.links.where("steps = 2"))
    assert rows(kept) == [("c000", "d"), ("d", "c040")]


def test_ways_are_followed(spark):
    steps = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("u", "v"), ("v", "u")], "mer string, to string")
    assert contract.followed(steps, "n00", "n20") == [f"n{i:02d}" for i in range(1, 20)]
    assert contract.followed(steps, "u", "n20") is None and contract.followed(steps, "n20", "n00") is None


def test_levels_are_those_of_a_search(spark):
    rng = random.Random(11)
    pairs = sorted({(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)} - {(f"n{i}", f"n{i}") for i in range(60)})
    want, front = {"n0": 0}, ["n0"]
    while front:
        front = sorted({b for a, b in pairs if a in front and b not in want})
        want |= {x: 1 + max(want.values()) for x in front}
    assert dict(rows(graph.levels(_edges(spark, pairs), "n0"))) == want


def test_graph_is_read_as_written(spark, tmp_path):
    nodes = spark.createDataFrame([("ABC", 1)], "mer string, cnt bigint")
    graph.write_graph(f"{tmp_path}/g", nodes, _edges(spark, [("ABC", "BCD")]), 3)
    assert rows(graph.read_graph(spark, f"{tmp_path}/g", 3)[1]) == [("ABC", "BCD")]
    try:
        graph.read_graph(spark, f"{tmp_path}/g", 4)
        raise AssertionError("no error")
    except ValueError:
        pass


def test_costs_stay_fixed():
    part = pd.DataFrame({"src": ["a", "b"], "dst": ["b", "a"], "steps": [1, 4], "cost": [2.0, 1.0], "low_src": ["a", "x"], "low_dst": ["b", "y"]})
    assert decycle._broken(part, 1)[["src", "dst"]].values.tolist() == [["x", "y"]]


def test_cost_names(spark):
    edges = _edges(spark, [("a", "b"), ("c", "b")])
    nodes = spark.createDataFrame([("a", 2), ("b", 3), ("c", 1)], "mer string, cnt bigint")
    got = graph.edge_costs(nodes, edges, graph.levels(edges, "a"), ["rss", "iso", "no such"]).where("src = 'a'").select("rss", "iso", "`no such`")
    assert rows(got) == [(7, 0, 7)]
