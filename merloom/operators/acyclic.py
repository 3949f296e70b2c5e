"""The mer graph over runs without cycles: which edges go, worked out in one task over numbers only.

A run is a node; an edge leads from each run that ends in a branch to each that begins there, but for a mer to itself. At
a branch the cost rss of an edge is a part of the one run and a part of the other, so sums over many edges are sums over
runs, and no edge has a row. Names of branches are to be exact (mers of at most 9 letters).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merloom.operators.compact import _ODD, NAME_BITS, Runs, _codes, _numbers, _parts, name_bits, spread
from merloom.operators.decycle import TASK_LINKS, _broken, strong_parts
from merloom.storage import forget, written

#: Share of the runs left that is placed at once; runs whose edges are looked at together.
PLACED, TOGETHER = 0.05, 1 << 19
#: Strongly connected parts are searched from single branches while more runs than this are left and the last part had as many.
FEW_RUNS = 50_000
FAR = np.iinfo(np.int32).max


class Net:
    """Runs as numbers: from branch `head` to branch `tail` over n mers that cnt rows hold; a row begins (ends) with some. before, after: the letter before the tail in the last mer, after the head in the first."""

    def __init__(self, head, tail, n, cnt, first, last, before, after, branches: int):
        self.head, self.tail, self.n, self.cnt, self.first, self.last, self.before, self.branches = head, tail, n, cnt, first, last, before, branches
        self.after, self.loop = after, (n == 1) & (head == tail)
        self.nin, self.nout = (np.bincount(x, minlength=branches) for x in (tail, head))
        # what a run gives to the cost of an edge from it, and to it
        self.out_cost = cnt * (1 + (self.nout[tail] + last - self.loop == 1))
        self.in_cost = cnt * (1 + (self.nin[head] + first - self.loop == 1))
        self.ways = Ways(head, tail, branches, self.loop)

    @property
    def edges(self) -> int:
        """All edges, those within runs and from the first and to the last node too."""
        return int((self.nin * self.nout).sum() - self.loop.sum() + (self.n - 1).sum() + self.first.sum() + self.last.sum())

    def ways_of(self, at: np.ndarray, back: bool = False) -> Ways:
        """The edges between the runs `at`, which are numbered anew; with `back` against their direction."""
        near, far = (self.tail, self.head) if back else (self.head, self.tail)
        return Ways(near[at], far[at], self.branches, self.loop[at])

    def only(self, at: np.ndarray) -> Net:
        """The graph of the runs `at` alone."""
        return Net(*(x[at] for x in (self.head, self.tail, self.n, self.cnt, self.first, self.last, self.before, self.after)), self.branches)

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Names of the edges from runs a to runs b."""
        return self.tail[a].astype(np.int64) << 10 | self.before[a].astype(np.int64) << 5 | self.after[b]

    def inner_keys(self, a: np.ndarray) -> np.ndarray:
        """Names that stand for one edge within each run; no letter is 0."""
        return self.head[a].astype(np.int64) << 10 | self.after[a]


class Ways:
    """The edges between runs, from branch to branch: those at a branch are all from each run to it to each run from it, but not those of `loop` to themselves."""

    def __init__(self, head: np.ndarray, tail: np.ndarray, branches: int, loop: np.ndarray | None = None):
        self.tail, self.loop = tail, loop if loop is not None and loop.any() else None
        self.order = np.argsort(head, kind="stable").astype(np.int32)
        self.begin = np.searchsorted(head[self.order], np.arange(branches + 1)).astype(np.int32)

    def pairs(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges from the runs `some`."""
        at = self.begin[self.tail[some]].astype(np.int64)
        size = self.begin[self.tail[some] + 1] - at
        a, b = np.repeat(some, size), self.order[spread(at, size)]
        if self.loop is not None:
            on = ~((a == b) & self.loop[a])
            a, b = a[on], b[on]
        return a, b

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(self.tail), TOGETHER):
            yield self.pairs(np.arange(k, min(k + TOGETHER, len(self.tail)), dtype=np.int32))


def _trimmed(head: np.ndarray, tail: np.ndarray, at: np.ndarray, branches: int, rounds: int) -> np.ndarray:
    """`at` without what has nothing before or after it, again and again."""
    for _ in range(rounds):
        keep = np.zeros(branches, bool)
        keep[tail[at]] = True
        left = at[keep[head[at]]]
        keep[:] = False
        keep[head[left]] = True
        left = left[keep[tail[left]]]
        if len(left) == len(at):
            break
        at = left
    return at


def _reached(head: np.ndarray, tail: np.ndarray, at: np.ndarray, branches: int, start: int | np.ndarray) -> np.ndarray:
    """Whether a way over the runs `at` leads from a branch (or one of several) to each branch."""
    order = at[np.argsort(head[at], kind="stable")]
    begin, to = np.searchsorted(head[order], np.arange(branches + 1)), tail[order]
    seen, new = np.zeros(branches, bool), np.unique(start)
    seen[new] = True
    while len(new):
        new = to[spread(begin[new], begin[new + 1] - begin[new])]
        new = np.unique(new[~seen[new]])
        seen[new] = True
    return seen


def cyclic(net: Net) -> tuple[np.ndarray, np.ndarray]:
    """The runs on cycles, both of whose branches are in one strongly connected part, and the numbers of their parts."""
    head, tail, size = net.head, net.tail, net.branches
    found, at, parts = [], np.flatnonzero(~net.loop), 0
    which = np.full(size, -1, np.int32)
    while len(at := _trimmed(head, tail, at, size, 4)) > FEW_RUNS:
        ends = np.minimum(np.bincount(head[at], minlength=size), np.bincount(tail[at], minlength=size))
        start = int(np.argmax(ends))
        down, up = _reached(head, tail, at, size, start), _reached(tail, head, at, size, start)
        which[down & up] = parts
        parts += 1
        inside = (which[head[at]] >= 0) & (which[head[at]] == which[tail[at]])
        found.append(at[inside])
        # no cycle leads out of the part, or out of what it reaches or is reached by
        kind = down + 2 * up
        at = at[(kind[head[at]] < 3) & (kind[head[at]] == kind[tail[at]])]
        if len(found[-1]) < FEW_RUNS:
            break
    at = _trimmed(head, tail, at, size, len(at) + 1)
    after: dict[int, set[int]] = {}
    for a, b in zip(head[at].tolist(), tail[at].tolist(), strict=True):
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    for k, part in enumerate(strong_parts(after), parts):
        which[part] = k
    # a branch with a run back to itself is a part too
    alone = np.unique(head[at[(head[at] == tail[at]) & (which[head[at]] < 0)]])
    which[alone] = which.max(initial=-1) + 1 + np.arange(len(alone))
    found.append(at[(which[head[at]] >= 0) & (which[head[at]] == which[tail[at]])])
    # a mer of one letter is on the cycles through its branch
    found.append(np.flatnonzero(net.loop & (which[head] >= 0)))
    runs = np.sort(np.concatenate(found))
    return runs, which[head[runs]]


def _lessen(total: np.ndarray, at: np.ndarray, by: np.ndarray | int) -> None:
    if len(at) * 8 < len(total):
        np.subtract.at(total, at, by)
    else:
        total -= np.bincount(at, None if isinstance(by, int) else by, len(total)).astype(total.dtype)


def placed(net: Net, at: np.ndarray) -> np.ndarray:
    """Places for the runs `at`, so that edges to earlier places cost little.

    Again and again a run with no edge to it from those left takes the next place, one with no edge from it the last; of
    the others go those whose costs of edges from and to those left differ most, some at once.
    """
    # only the branches that these runs have
    number = np.zeros(net.branches, np.int32)
    number[net.head[at]] = number[net.tail[at]] = 1
    number = np.cumsum(number, dtype=np.int32) - 1
    size = int(number.max(initial=-1)) + 1
    head, tail = number[net.head[at]], number[net.tail[at]]
    a, b = net.out_cost[at].astype(np.float64), net.in_cost[at].astype(np.float64)
    nin, nout, ins, outs = (np.bincount(x, w, size).astype(np.float64) for x, w in ((tail, None), (head, None), (tail, a), (head, b)))
    place, low, high = np.zeros(len(at), np.int32), 0, len(at)
    at = np.arange(len(at))
    while len(at):
        into, out = b * nin[head] + ins[head], a * nout[tail] + outs[tail]
        none = nin[head] == 0
        into[none], out[nout[tail] == 0] = 0, 0
        lean = (out - into) / np.maximum(out + into, 1)
        lean[none] = 2
        most = np.abs(lean)
        k = len(at) - max(1, int(len(at) * PLACED))
        go = np.flatnonzero(most >= min(1, np.partition(most, k)[k]))
        go = go[np.argsort(-most[go], kind="stable")]
        front, back = go[lean[go] >= 0], go[lean[go] < 0]
        place[at[front]] = np.arange(low, low + len(front))
        place[at[back]] = np.arange(high - 1, high - 1 - len(back), -1)
        low, high = low + len(front), high - len(back)
        for total, x, by in ((nin, tail, None), (nout, head, None), (ins, tail, a), (outs, head, b)):
            _lessen(total, x[go], 1 if by is None else by[go])
        left = np.ones(len(at), bool)
        left[go] = False
        at, head, tail, a, b = at[left], head[left], tail[left], a[left], b[left]
    return place


def _steps(ways: Ways, out: np.ndarray, into: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The most edges on a way to each run over edges with out < into, none through runs that are cut."""
    size = len(out)
    missing = np.zeros(size, np.int32)
    for a, b in ways.parts():
        missing += np.bincount(b[out[a] < into[b]], minlength=size).astype(np.int32)
    steps, n = np.zeros(size, np.int32), 0
    new = np.flatnonzero((missing == 0) | cut).astype(np.int32)
    while len(new):
        steps[new] = n
        a, b = ways.pairs(new)
        b = b[(out[a] < into[b]) & ~cut[b]]
        _lessen(missing, b, 1)
        b = np.unique(b)
        new, n = b[missing[b] == 0], n + 1
    return steps


def _cuts(net: Net, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the runs `at` are better cut inside: the edges a to b that go cost more than one edge within."""
    size, n, own = len(at), net.n[at], 4 * net.cnt[at].astype(np.float64)
    cost, cut = (net.out_cost[at[a]] + net.in_cost[at[b]]).astype(np.float64), np.zeros(len(at), bool)
    while True:
        gain = np.bincount(a, cost, size) + np.bincount(b, np.where(a == b, 0, cost), size) - own
        gain[(n == 1) | cut] = 0
        rank, most = np.empty(size, np.int64), np.full(size, -1)
        rank[np.argsort(gain, kind="stable")] = np.arange(size)
        # one that gains more than those it shares an edge with
        np.maximum.at(most, a, rank[b])
        np.maximum.at(most, b, rank[a])
        now = (gain > 0) & (rank >= most)
        if not now.any():
            return cut
        cut |= now
        left = ~(now[a] | now[b])
        a, b, cost = a[left], b[left], cost[left]


def broken(net: Net, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What goes so that the runs `at` have no cycle: edges from the first to the second runs, and runs that are cut inside.

    Edges that lead back in an order by place; some runs are cut instead; edges that close no cycle with those that are
    left come back: those along the most steps from the beginnings, then from the ends.
    """
    place = placed(net, at)
    ways, back = net.ways_of(at), net.ways_of(at, back=True)

    def gone(out: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = [(a[w], b[w]) for a, b in ways.parts() if len(w := np.flatnonzero(out[a] >= into[b]))]
        return tuple(np.concatenate(x) for x in zip(*some, strict=True)) if some else (np.empty(0, np.int32),) * 2

    cut = _cuts(net, at, *gone(place, place))
    out, into = np.where(cut, -FAR, place), np.where(cut, FAR, place)
    steps = _steps(ways, out, into, cut)
    out, into = np.where(cut, -FAR, steps), np.where(cut, FAR, steps)
    steps = -_steps(back, -into, -out, cut)
    a, b = gone(np.where(cut, -FAR, steps), np.where(cut, FAR, steps))
    return at[a], at[b], at[cut]


def removals(net: Net) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Keys and costs of the edges that go from large parts, and the links of parts of at most TASK_LINKS links for decycle's search by cycles."""
    at, part = cyclic(net)
    inner = np.bincount(part, net.n[at] > 1)
    ways = net.ways_of(at)
    for a, _ in ways.parts():
        inner += np.bincount(part[a], minlength=len(inner))
    few = inner[part] <= TASK_LINKS
    a, b, cut = broken(net, at[~few])
    keys = np.r_[net.keys(a, b), net.inner_keys(cut)]
    cost = np.r_[net.out_cost[a] + net.in_cost[b], 4 * net.cnt[cut]]
    at, part = at[few], part[few]
    ways = net.ways_of(at)
    a, b = (np.concatenate(x) for x in zip(*ways.parts(), strict=True)) if len(at) else (np.empty(0, np.int32),) * 2
    long = np.flatnonzero(net.n[at] > 1)
    # the first and the last mer of a run are two nodes if it has more than one
    links = {
        "part": np.r_[part[a], part[long]],
        "src": np.r_[2 * a.astype(np.int64) + (net.n[at[a]] > 1), 2 * long],
        "dst": np.r_[2 * b.astype(np.int64), 2 * long + 1],
        "steps": np.r_[np.ones(len(a), np.int64), net.n[at[long]] - 1],
        "cost": np.r_[net.out_cost[at[a]] + net.in_cost[at[b]], 4 * net.cnt[at[long]]],
        "key": np.r_[net.keys(at[a], at[b]), net.inner_keys(at[long])],
    }
    return keys, cost, links


def on_cycles(net: Net, keys: np.ndarray) -> int:
    """How many edges are on a cycle without those named by the sorted keys."""
    inner = keys[keys >> 5 & 31 == 0]
    cut = np.isin(net.inner_keys(np.arange(len(net.head))), inner)
    some = np.zeros(net.branches, bool)
    some[keys >> 10] = True

    def kept(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = net.ways.pairs(new)
        known = np.flatnonzero(some[net.tail[a]])
        name = net.keys(a[known], b[known])
        out = np.zeros(len(a), bool)
        out[known] = keys[np.minimum(np.searchsorted(keys, name), len(keys) - 1)] == name if len(keys) else False
        return a[~out], b[~out]

    missing, left = np.zeros(len(cut), np.int32), np.ones(len(cut), bool)
    for k in range(0, len(cut), TOGETHER):
        missing += np.bincount(kept(np.arange(k, min(k + TOGETHER, len(cut))))[1], minlength=len(cut)).astype(np.int32)
    # what is reached from no cycle goes; so does the end of a run that is cut, as nothing leads to it
    new = np.flatnonzero((missing == 0) | cut)
    while len(new):
        left[new] = False
        _, b = kept(new)
        b = b[~cut[b]]
        _lessen(missing, b, 1)
        b = np.unique(b)
        new = b[(missing[b] == 0) & left[b]]
    a, b = kept(np.flatnonzero(left))
    a, b = a[left[b]], b[left[b]]
    after: dict[int, set[int]] = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        after.setdefault(x, set()).add(y)
        after.setdefault(y, set())
    part = np.full(len(cut), -1)
    for k, nodes in enumerate(strong_parts(after)):
        part[nodes] = k
    own = np.flatnonzero((part < 0) & np.isin(np.arange(len(cut)), a[a == b]))
    part[own] = part.max(initial=-1) + 1 + np.arange(len(own))
    return int(((part[a] >= 0) & (part[a] == part[b])).sum() + (net.n[part >= 0] - 1).sum())


def _net(batches: Iterator[pa.RecordBatch], branches: int) -> Net:
    table = pa.Table.from_batches(held) if (held := list(batches)) else None
    kinds = {"head": np.int32, "tail": np.int32, "n": np.int32, "cnt": np.int64, "first": bool, "last": bool, "before": np.int32, "after": np.int32}
    return Net(*(np.empty(0, k) if table is None else table.column(c).to_numpy().astype(k, copy=False) for c, k in kinds.items()), branches)


def _letters(found: Runs) -> DataFrame:
    """The numbers of runs and the letters at both ends, in one partition."""
    letter = lambda k: (F.ascii(F.substring("text", k, 1)) - 64).cast("int")
    return _numbers(found, letter(-found.e).alias("before"), letter(found.e).alias("after"))


def removed_keys(found: Runs, seed: int = 1, low: float = -1, prepared: Callable[[Net], Net] = lambda net: net) -> DataFrame:
    """key, cost of the edges that go; a written table. Runs with a count of at most `low` are left out, then others by `prepared`."""
    branches, names = found.branches, ["part", "src", "dst", "steps", "cost", "key"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, cost, links = removals(prepared(_net(batches, branches)))
        none = np.zeros(len(keys), np.int64)
        for rows in ([none - 1, none, none, none, cost, keys], [links[k] for k in names]):
            yield from pa.table([np.asarray(x, np.int64) for x in rows], names=names).to_batches()

    done = written(_letters(found).where(F.col("cnt") > low).mapInArrow(task, ", ".join(f"{k} bigint" for k in names)), "removals")
    links = done.where("part >= 0").withColumns({"low_src": F.col("key"), "low_dst": F.lit(0)})
    small = links.groupBy("part").applyInPandas(lambda rows: _broken(rows, seed), "src bigint, dst bigint, cost double")
    keys = written(done.where("part < 0").select("key", "cost").unionByName(small.select(F.col("src").alias("key"), F.col("cost").cast("bigint").alias("cost"))), "gone")
    forget(done)
    return keys


def _inverse(names: np.ndarray, m: int) -> np.ndarray:
    """The letters 1-26 of places of m letters, a row for each."""
    h = names.astype(np.uint64) * np.uint64(pow(int(_ODD), -1, 1 << 64)) & np.uint64((1 << name_bits(m)) - 1)
    return np.stack([(h >> np.uint64(5 * (m - 1 - j)) & np.uint64(31)).astype(np.uint8) for j in range(m)], axis=1) if len(h) else np.empty((0, m), np.uint8)


def _texts_of(letters: np.ndarray) -> pa.Array:
    n, m = letters.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(m)), pa.py_buffer(np.ascontiguousarray(letters + np.uint8(64))))


def edges_named(found: Runs, keys: DataFrame) -> DataFrame:
    """src, dst, cost of the edges named by (key, cost): within a run the first by name."""
    spark, e = keys.sparkSession, found.e
    shared = spark.sparkContext.broadcast(found.names)

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            both = np.column_stack([(key >> 5 & 31).astype(np.uint8), _inverse(shared.value[key >> 10], e - 1), (key & 31).astype(np.uint8)])
            yield pa.RecordBatch.from_arrays([_texts_of(both[:, :e]), _texts_of(both[:, 1:]), batch.column(1)], ["src", "dst", "cost"])

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for x, begin in _parts(batch.column(0)):
                size = np.diff(np.r_[begin, len(x)]) - 1 - e
                code = _codes(x, e, len(x))
                at = spread(begin, size)
                start = np.cumsum(size) - size
                least = np.minimum.reduceat(code[at], start)
                low = at[code[at] == np.repeat(least, size)]
                both = x[low[:, None] + np.arange(e + 1)]
                yield pa.RecordBatch.from_arrays([_texts_of(both[:, :e]), _texts_of(both[:, 1:]), batch.column(1).slice(done, len(begin))], ["src", "dst", "cost"])
                done += len(begin)

    schema = "src string, dst string, cost bigint"
    own = keys.where("key & 992 = 0")
    runs = found.table.select("text", (F.col("head").cast("bigint") * 1024 + F.ascii(F.substring("text", e, 1)) - 64).alias("key")).join(own, "key").select("text", "cost")
    return keys.where("key & 992 <> 0").mapInArrow(crossing, schema).unionByName(runs.mapInArrow(inner, schema))


def removal_facts(found: Runs) -> DataFrame:
    """decycle.removal_facts(): the edges that go are written, and the whole graph is searched for cycles without them."""
    keys, spark, branches = removed_keys(found), found.table.sparkSession, found.branches
    gone = written(edges_named(found, keys), "removed")
    shared = spark.sparkContext.broadcast(np.sort(keys.select("key").toArrow().column(0).to_numpy()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = _net(batches, branches)
        yield pa.RecordBatch.from_arrays([pa.array([net.edges]), pa.array([on_cycles(net, shared.value)])], ["edges", "left_on_cycles"])

    facts = written(_letters(found).mapInArrow(task, "edges bigint, left_on_cycles bigint"), "facts")
    return facts.join(gone.agg((F.count("*") > 0).alias("some_removed")))
