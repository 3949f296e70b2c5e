import random

import numpy as np
import pytest
from conftest import rows

from merloom.operators import acyclic, compact, decycle, graph, greedy, paths, tally
from merloom.plans import core
from merloom.plans.design import Design, design
from merloom.plans.design_runs import design_table


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Tiny tables and many jobs: one task a stage."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "2")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Families of varied texts with repeats, single letters, short, empty and null ones."""
    rng = random.Random(5)
    base = ["".join(rng.choice("ABCDE") for _ in range(40)) for _ in range(4)]
    texts = [t[rng.randrange(9) : 40 - rng.randrange(9)] for t in base for _ in range(6)]
    texts = [t[:k] + rng.choice("ABCW") + t[k + 1 :] for t in texts for k in [rng.randrange(len(t))]]
    texts += ["A" * 14, "B" + "A" * 9 + "MC", base[0] + base[0][:20], base[1][:9], base[1][:8], "a-b c", "", None]
    d = str(tmp_path_factory.mktemp("compact"))
    spark.createDataFrame([(i, f"n{i}", t) for i, t in enumerate(texts)], "ord bigint, name string, seq string").write.parquet(f"{d}/sequences.parquet")
    return d


@pytest.fixture(scope="module")
def tables(spark, folder):
    """nodes, edges, levels by the searches over tables."""
    nodes, edges = core.graph_tables(spark, folder)
    return nodes, edges, core.graph_levels(spark, folder)


def _jobs(spark, name, folder):
    """The rows of a query and the number of its jobs."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        got = rows(core.LONG[name](spark, folder))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_levels(spark, folder, tables):
    got, jobs = _jobs(spark, "bfs_levels", folder)
    assert got == rows(tables[2]) and len(got) > 100 and jobs < 15


def test_runs_are_passed_whole(spark, folder):
    """All mers of a run have the run's count, and each mer is in one run."""
    population = core._population(spark, folder)
    assert rows(compact.nodes(compact.runs(population.select("seq"), 9))) == rows(tally.mer_tally(population, 9))


def test_no_text_has_a_mer(spark):
    found = compact.runs(spark.createDataFrame([("ABC",), ("",)], "seq string"), 9)
    assert rows(compact.levels(found)) == [(graph.BEGIN, 0)] and found.table.isEmpty()


def test_too_many_branches_take_the_tables(spark, monkeypatch):
    monkeypatch.setattr(compact, "MOST_BRANCHES", 1)
    assert compact.runs(spark.createDataFrame([("ABCDEFGHIJKL",)], "seq string"), 9) is None


def test_hashed_names_cut_enough(spark):
    """Places of 14 letters are named by a hash; every mer of 15 letters is in one run with its count."""
    texts = spark.createDataFrame([("ABCDEFGHIJKLMNOPQRST",), ("ABCDEFGHIJKLMNOPQRXY",), ("CDEFGHIJKLMNOPQRSTUV",)], "seq string")
    found = compact.runs(texts, 15)
    assert rows(compact.nodes(found)) == rows(tally.mer_tally(texts, 15))
    assert np.all(np.diff(compact.branches(texts, 15)) > 0)


def test_forward_edges(spark, folder, tables):
    got, jobs = _jobs(spark, "forward_edges", folder)
    assert got == rows(graph.forward(*tables[1:])) and jobs < 20


def test_node_values(spark, folder, tables):
    got, jobs = _jobs(spark, "best_node_values", folder)
    want = paths.best_values(tables[0], graph.forward(*tables[1:])).selectExpr("mer", "cast(value as bigint)")
    assert got == rows(want) and jobs < 15


def test_complementary_ways(spark, folder, tables):
    """The ways are those found over tables, ties and all."""
    got, jobs = _jobs(spark, "complementary_paths", folder)
    forward = graph.forward(*tables[1:])
    ways = paths.complementary_paths(tables[0], forward, 2)
    assert got == rows(paths.way_facts(ways, tables[0], forward)) and len(got) == 2 and jobs < 30
    assert rows(compact.complementary_texts(core.graph_runs(spark, folder), 2)) == rows(paths.paths_to_text(ways))


def test_bandwidth(spark, folder, tables):
    got, jobs = _jobs(spark, "path_bandwidth", folder)
    want = paths.best_values(tables[0], graph.forward(*tables[1:]), True).where(f"mer = '{graph.END}'")
    assert got == [(int(want.first()["value"]),)] and jobs < 15


def test_best_score(spark, folder, tables):
    got, jobs = _jobs(spark, "best_path_score", folder)
    assert got == [(int(paths.best_path(tables[0], graph.forward(*tables[1:]))[0]),)] and jobs < 15


def test_edge_costs(spark, folder, tables):
    got, jobs = _jobs(spark, "edge_costs", folder)
    assert got == rows(graph.edge_costs(*tables)) and jobs < 25


def test_trimmed(spark, folder, tables):
    got, jobs = _jobs(spark, "trim_dead", folder)
    gone = tables[0].where("mer like '%WW%' or mer like '%MC%'").select("mer")
    want = graph.without_dead_begins(graph.without_dead_ends(graph.without(graph.forward(*tables[1:]), gone)))
    assert not gone.isEmpty() and got == rows(want) and jobs < 20


def test_kmer_scores(spark, folder):
    population = core._population(spark, folder)
    want = greedy.scores(greedy.long_mers(population, core.K), tally.mer_tally(population, 9), 9)
    assert rows(core.kmer_scores(spark, folder)) == rows(want) and "Join" not in core.kmer_scores(spark, folder)._jdf.queryExecution().toString()


def test_greedy_kmers(spark, folder):
    members = greedy.member_counts(core._population(spark, folder), core.K, 9)
    held = core.kmer_pool(spark, folder)
    some = members.agg({"kmer": "max"}).first()[0]
    assert [tuple(r) for r in core.greedy_kmers(spark, folder).orderBy("pick").collect()] == [(i + 1, *p) for i, p in enumerate(greedy.greedy(members, 3))]
    assert greedy.greedy(held, 3, [some]) == greedy.greedy(members, 3, [some])


def test_refined_kmers(spark, folder):
    members = greedy.member_counts(core._population(spark, folder), core.K, 9)
    assert greedy.refined(core.kmer_pool(spark, folder), 3, 1) == greedy.refined(members, 3, 1)
    assert [tuple(r)[:3] for r in core.refined_kmers(spark, folder).collect()] == [(3, True, True)]


def test_refined_kmers_take_few_passes(spark, folder):
    """The picks of the tables, whether all mers are held or so few that the texts are passed again."""
    members = greedy.member_counts(core._population(spark, folder), core.K, 9)
    texts, found = core._population(spark, folder).select("seq"), core.graph_runs(spark, folder)
    few, all_ = (compact.Heads(texts, core.K, found, most, draws=2) for most in (2, 1_024))
    for n, given in ((3, []), (40, []), (3, [all_.top[-1][0]]), (3, ["MMMMMMMMMMMMMMM"])):
        want = greedy.greedy(members, n, given)
        assert greedy.greedy(all_, n, given) == want and (n > 3 or greedy.greedy(few, n, given) == want)
    assert greedy.refined(all_, 5, 2) == greedy.refined(members, 5, 2) and greedy.restarted(few, 3, 7) == greedy.restarted(members, 3, 7)
    assert [len(h.top) for h in (few, all_)] == [2, members.select("kmer").distinct().count()]
    got, jobs = _jobs(spark, "refined_kmers", folder)
    assert got == [(3, True, True, sum(s for _, s in greedy.greedy(members, 3)))] and jobs < 25


def test_hashes_are_those_of_spark(spark):
    texts = ["ABCDEFGHIJKLMNOPQRSTUVWXYZAABBC", "QWERTYUIOPASDFGHJKLZXCVBNMMNBVC"]
    for k in (3, 9, 15, 31):
        want = [r[0] for r in spark.createDataFrame([(t[:k],) for t in texts], "t string").selectExpr("xxhash64(7, t)").collect()]
        assert [int(compact.hashed(np.array([ord(c) - 64 for c in t], np.uint8), 1, k, 7)[0]) for t in texts] == want


def test_quarter_is_chosen_without_an_order_of_all(spark, folder):
    """The cut falls among tied scores."""
    got = rows(core.pool_quarter(spark, folder))
    scored = core.kmer_scores(spark, folder)
    assert got == rows(greedy.best_quarter(scored)) and scored.where(f"score = {min(s for _, s in got)}").count() > sum(s == min(s for _, s in got) for _, s in got)
    assert "TakeOrderedAndProject(limit=" + str(len(got)) not in core.pool_quarter(spark, folder)._jdf.queryExecution().toString()


def test_cycles_go_over_runs(spark, folder, tables, monkeypatch):
    """Only edges on cycles go, each at its cost, and none closes a cycle with those left; with and without the search by cycles. A mer of one letter is a way round an edge at its branch."""
    nodes, edges, placed = tables
    costs = {(a, b): c for a, b, c in rows(graph.edge_costs(nodes, edges, placed, ["rss"]))}
    on_cycle = set(rows(decycle.cyclic_edges(edges)))
    found = core.graph_runs(spark, folder)
    for links in (4_000, 0):
        monkeypatch.setattr(acyclic, "TASK_LINKS", links)
        gone = {(a, b): c for a, b, c in rows(acyclic.edges_named(found, acyclic.removed_keys(found)))}
        assert gone and gone.keys() <= on_cycle and all(costs[k] == c for k, c in gone.items())
        after = {}
        for a, b in costs.keys() - gone.keys():
            after.setdefault(a, set()).add(b)
            after.setdefault(b, set())
        assert not decycle.strong_parts(after)
    got, jobs = _jobs(spark, "decycle_removed", folder)
    assert got == [(len(costs), 0, True)] and jobs < 40


def test_edges_on_cycles_are_counted(spark, folder, tables):
    """With nothing removed, those that the search over tables finds."""
    found = core.graph_runs(spark, folder)
    columns = acyclic._letters(found).toArrow()
    net = acyclic._net(iter(columns.to_batches()), found.branches)
    assert acyclic.on_cycles(net, np.empty(0, np.int64)) == decycle.cyclic_edges(tables[1]).count() and net.edges == tables[1].count()


def test_design_over_runs(spark, folder, tables):
    """Without cycles the design over tables; with them ways whose steps are edges, and the share of what they cover."""
    got, jobs = _jobs(spark, "design_antigens", folder)
    assert got and jobs < 50
    p = Design(e=9, m=2, low_nodes=2)
    found = core.graph_runs(spark, folder)
    assert rows(design_table(found, p)) == rows(design(core._population(spark, folder), p))
    counts, edges = dict(rows(tables[0])), set(rows(tables[1]))
    for trials in (1, 5):
        made = design_table(found, Design(e=9, m=3, trials=trials, extra=1)).orderBy("path_id").collect()
        ways = [[r["seq"][k : k + 9] for k in range(len(r["seq"]) - 8)] for r in made]
        assert len(made) == 3 and all(s in edges for w in ways for s in zip([graph.BEGIN, *w], [*w, graph.END], strict=True))
        assert made[0]["share"] == sum(counts[x] for x in {x for w in ways for x in w}) / sum(counts.values())
    with pytest.raises(ValueError, match="END can't"):
        design_table(found, Design(e=9, low_nodes=99))
    with pytest.raises(ValueError, match="holds no mer"):
        design_table(compact.runs(spark.createDataFrame([("ABC",)], "seq string"), 9), p)


def test_parts_are_those_of_the_search(monkeypatch):
    """Many small parts beside a large one, found from single branches and all at once; small ones take few searches."""
    rng = np.random.default_rng(8)
    head, tail = (np.r_[rng.integers(0, 60, 150), 60 + 3 * np.arange(200) + a].astype(np.int32) for a in (0, 1))
    head, tail = np.r_[head, tail[150:]], np.r_[tail, head[150:]]
    one = np.ones(len(head), np.int32)
    net = acyclic.Net(head, tail, 2 * one, one, one > 1, one > 1, one, one, 700)
    searches, real = [], acyclic._reached
    monkeypatch.setattr(acyclic, "_reached", lambda *x: searches.append(1) or real(*x))
    found = []
    for few in (100, 1_000):
        monkeypatch.setattr(acyclic, "FEW_RUNS", few)
        runs, part = acyclic.cyclic(net)
        found.append((runs.tolist(), {tuple(runs[part == p]) for p in set(part.tolist())}))
    assert found[0] == found[1] and len(found[0][1]) >= 200 and 2 <= len(searches) <= 6
