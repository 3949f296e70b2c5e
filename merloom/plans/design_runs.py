"""The design over runs: cleaning, cycle removal and the search for ways in one task each, over numbers only."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merloom.operators.acyclic import Net, _inverse, _letters, _net, _reached, removed_keys
from merloom.operators.compact import Runs
from merloom.storage import written


def ended(net: Net) -> Net:
    """Where no run begins (ends) a row, those that nothing leads to (from) do."""
    if not net.first.any():
        net.first = net.nin[net.head] - net.loop == 0
    if not net.last.any():
        net.last = net.nout[net.tail] - net.loop == 0
    return net


def _fed(near: np.ndarray, far: np.ndarray, stop: np.ndarray, loop: np.ndarray, at: np.ndarray, branches: int) -> np.ndarray:
    """`at` without runs that no other leads on from, but for those at a stop, again and again."""
    while True:
        some = np.bincount(near[at], minlength=branches)
        left = at[stop[at] | (some[far[at]] - loop[at] > 0)]
        if len(left) == len(at):
            return at
        at = left


def cleaned(net: Net) -> Net:
    """As graph.cleaned(): the runs left without dead ends and dead begins that a beginning reaches; none if no end is reached."""
    net = ended(net)
    at = _fed(net.head, net.tail, net.last, net.loop, np.arange(len(net.head)), net.branches)
    at = _fed(net.tail, net.head, net.first, net.loop, at, net.branches)
    seen = _reached(net.head, net.tail, at, net.branches, net.tail[at[net.first[at]]])
    at = at[net.first[at] | seen[net.head[at]]]
    return net.only(at if net.last[at].any() else at[:0])


class Acyclic:
    """The runs on ways from the beginning to the end without the edges named by sorted keys, and the edges between them, by source and by target."""

    def __init__(self, net: Net, keys: np.ndarray, names: np.ndarray, e: int):
        net = cleaned(net)
        size = len(net.head)
        a, b = net.ways.pairs(np.arange(size))
        alive = ~np.isin(net.inner_keys(np.arange(size)), keys)
        left = ~np.isin(net.keys(a, b), keys)
        a, b = a[left], b[left]
        while True:
            left = alive[a] & alive[b]
            a, b = a[left], b[left]
            now = alive & (net.first | (np.bincount(b, minlength=size) > 0)) & (net.last | (np.bincount(a, minlength=size) > 0))
            if now.sum() == alive.sum():
                break
            alive = now
        self.net, self.alive, self.names, self.e = net, alive, names, e
        self.starts = self._grouped(a, b, size)
        self.ends = self._grouped(b, a, size)
        self.rounds = self._rounds(b, size)

    @staticmethod
    def _grouped(near: np.ndarray, far: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(near, kind="stable")
        return np.searchsorted(near[order], np.arange(size + 1)), far[order]

    def _beside(self, group: tuple[np.ndarray, np.ndarray], run: int) -> np.ndarray:
        return group[1][group[0][run] : group[0][run + 1]]

    def _rounds(self, b: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The edges in groups, so that all edges to the sources of a group are in groups before."""
        missing, found = np.bincount(b, minlength=size), []
        begin, to = self.starts
        new = np.flatnonzero(self.alive & (missing == 0))
        while len(new):
            n = begin[new + 1] - begin[new]
            far = to[np.repeat(begin[new] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            found.append((np.repeat(new, n), far))
            np.subtract.at(missing, far, 1)
            far = np.unique(far)
            new = far[missing[far] == 0]
        if sum(len(x) for x, _ in found) < len(b):
            raise ValueError("the graph has a cycle")
        return found

    def best(self, cnt: np.ndarray) -> list[int]:
        """A best way by sums of counts: from the end back, always the smallest of the best mers before."""
        net = self.net
        own, before = net.n * cnt, np.where(net.first, 0, -1)
        for a, b in self.rounds:
            np.maximum.at(before, b, before[a] + own[a])
        ends = np.flatnonzero(self.alive & net.last)
        total = before[ends] + own[ends]
        ends = ends[total == total.max()]
        mers = np.column_stack([net.before[ends].astype(np.uint8), _inverse(self.names[net.tail[ends]], self.e - 1)])
        way = [int(ends[np.lexsort(mers.T[::-1])[0]])]
        # the first node has a name before those of all mers
        while not (net.first[way[-1]] and before[way[-1]] == 0):
            into = self._beside(self.ends, way[-1])
            into = into[before[into] + own[into] == before[way[-1]]]
            way.append(int(into[np.argmin(net.before[into])]))
        return way[::-1]

    def score(self, ways: list[list[int]]) -> int:
        some = np.unique(np.concatenate(ways)).astype(np.int64) if ways else np.empty(0, np.int64)
        return int((self.net.n[some] * self.net.cnt[some]).sum())

    def random(self, seed: str, start: int | None = None, back: bool = False) -> list[int]:
        """The runs after `start` (the beginning) on a random way to the end; with `back` those before it, in order."""
        net, way = self.net, []
        group, stop = (self.ends, net.first) if back else (self.starts, net.last)
        while True:
            near = way[-1] if way else start
            to = np.flatnonzero(self.alive & net.first) if near is None else self._beside(group, near)
            some = [*net.inner_keys(to).tolist(), *([-1] if near is not None and stop[near] else [])]
            from_ = -1 if near is None else int(net.inner_keys(np.array([near]))[0])
            k = min(range(len(some)), key=lambda i: hashlib.blake2b(f"{seed}:{from_}:{some[i]}".encode(), digest_size=8).digest())
            if some[k] == -1:
                return way[::-1] if back else way
            way.append(int(to[k]))

    def half_kept(self, way: list[int], seed: str) -> list[int]:
        """As paths.half_kept_way(): a random beginning or end of a way stays, the rest goes a random way."""
        rng = random.Random(f"{seed}:half")
        ends = np.cumsum(self.net.n[way])
        k = int(np.searchsorted(ends, rng.randrange(int(ends[-1])), "right"))
        if rng.random() < 0.5:
            return [*way[: k + 1], *self.random(seed, way[k])]
        return [*self.random(seed, way[k], back=True), *way[k:]]

    def complementary(self, m: int, extra: int, start: list[list[int]]) -> tuple[int, list[list[int]]]:
        """As paths.complementary_ways() without fixed ways."""
        ways = start[:m]
        idle, score = 0, self.score(ways)
        for _ in range(m + extra):
            if idle and idle >= m - 1:
                break
            out = ways.pop(0) if len(ways) >= m else None
            left = self.net.cnt.copy()
            left[[k for w in ways for k in w]] = 0
            way = self.best(left)
            new = self.score([*ways, way])
            if new > score:
                ways.append(way)
                score, idle = new, 0
            else:
                if out is not None:
                    ways.append(out)
                idle += 1
        return score, ways

    def trials(self, m: int, extra: int, trials: int, seed: int) -> tuple[list[int], list[list[int]]]:
        """The score of each trial and the ways of the best, as design.design_trials() without fixed ways and hints."""
        scores, best, rng = [], [], random.Random(f"{seed}:trials")
        for trial in range(trials):
            by = f"{seed}:{trial}"
            if not trial:
                start = []
            elif trial % 2 or not best:
                start = [self.random(by)]
            else:
                start = [self.half_kept(rng.choice(best), by)]
            score, ways = self.complementary(m, extra, start)
            if not scores or score > max(scores):
                best = ways
            scores.append(score)
        return scores, best


def best_ways(found: Runs, low: float, m: int, extra: int, trials: int, seed: int) -> tuple[list[int], list[str]]:
    """The score of each trial, and the texts of the best ways through the graph of mers with a count above `low`; an error if there is no way."""
    keys, spark = removed_keys(found, seed, low, cleaned), found.table.sparkSession
    shared = spark.sparkContext.broadcast((np.sort(keys.select("key").toArrow().column(0).to_numpy()), found.names))
    branches, e = found.branches, found.e

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Acyclic(_net(batches, branches), *shared.value, e)
        if graph.alive.any():
            scores, ways = graph.trials(m, extra, trials, seed)
            rows = [(-1, k, x) for k, x in enumerate(scores)] + [(i, k, int(x)) for i, w in enumerate(ways) for k, x in enumerate(graph.net.inner_keys(np.array(w)))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["path_id", "step", "key"])

    done = written(_letters(found).where(F.col("cnt") > low).mapInArrow(task, "path_id bigint, step bigint, key bigint"), "ways")
    key = F.col("head").cast("bigint") * 1024 + F.ascii(F.substring("text", e, 1)) - 64
    scores = [r["key"] for r in done.where("path_id = -1").orderBy("step").collect()]
    if not scores:
        raise ValueError("END can't be reached from BEGIN")
    ways: dict[int, str] = {}
    for r in done.where("path_id >= 0").join(found.table.select("text", key.alias("key")), "key").orderBy("path_id", "step").collect():
        ways[r["path_id"]] = ways.get(r["path_id"], r["text"][: e - 1]) + r["text"][e - 1 :]
    return scores, [ways[k] for k in sorted(ways)]


def total_count(found: Runs) -> int:
    """The sum of the counts of all mers."""
    return found.table.agg(F.sum((F.length("text") - (found.e - 1)) * F.col("cnt"))).first()[0] or 0


def design_table(found: Runs, p) -> DataFrame:
    """path_id, name, seq, share, as design.design() of the population of the runs. Only for plain counts and the cost rss, without fixed ways, hints and filters."""
    if p.m == 1 and p.trials > 1:
        raise ValueError("several trials need m above 1")
    if p.cost != "rss" or p.fixed or p.hints or p.drop_weak or p.low_edges or p.reverse or p.tmr or p.span or p.e != found.e:
        raise ValueError("this design does not go by runs")
    total = total_count(found)
    if not total:
        raise ValueError("the population holds no mer")
    scores, texts = best_ways(found, p.low_nodes, p.m, p.extra, p.trials, p.seed)
    rows = [(k, p.names[k] if k < len(p.names) else f"EG-{k}", text, max(scores) / total) for k, text in enumerate(texts)]
    return found.table.sparkSession.createDataFrame(rows, "path_id int, name string, seq string, share double")
