"""The mer graph of a population by its unbranched ways, without a row for each mer.

A mer of e letters is a step from its first e - 1 letters to its last. Letters between which no text branches, begins or
ends are passed by all texts alike, so the texts are cut only at the other places, the branches: what lies between two of
them (a run) is passed whole or not at all, and all its mers have one count. There are a tenth as many runs as mers.
Texts hold letters A-Z only.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merloom.operators.graph import BEGIN, END
from merloom.operators.paths import way_facts
from merloom.storage import forget, tasks_for, written

#: Letters that are worked on at once, and entries that are sent at once.
LETTERS, SENT = 1 << 20, 3 << 20
#: Bits of a place's name: exact for up to 8 letters, else a hash; places that share a hash are cut, which is harmless.
NAME_BITS = 44
#: Branches that each Python worker holds at most (8 bytes each); with more the graph is searched as tables.
MOST_BRANCHES = 12_000_000
#: Long mers of the largest scores, and of the smallest hashes, that the driver holds.
MOST_HEADS, MOST_DRAWN = 1_024, 16
_ODD, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Runs(NamedTuple):
    """table: text, head, tail (numbers of the branches at both ends), cnt (rows that hold it), first, last (whether a row begins, ends with it). e: letters of a mer. names: those of the branches, in order."""

    table: DataFrame
    e: int
    names: np.ndarray

    @property
    def branches(self) -> int:
        return len(self.names)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order. x is sorted in place: np.unique() hashes, which takes several times as long."""
    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (size of each)."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text begins and the last ends."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2]
    return np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8), offsets


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts in parts of about LETTERS: letters 1-26 with a 0 after each text, and where each begins."""
    data, offsets = _texts(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + LETTERS, "right")) - 1)
        size = np.diff(offsets[a : b + 1])
        begin = np.cumsum(size + 1) - size - 1
        x = np.zeros(int(size.sum()) + b - a, np.uint8)
        x[spread(begin, size)] = data[offsets[a] : offsets[b]] - np.uint8(64)
        yield x, begin
        a = b


def name_bits(m: int) -> int:
    return min(5 * m, NAME_BITS)


def _mixed(h: np.ndarray, m: int) -> np.ndarray:
    """Names of name_bits(m) bits, spread evenly; one to one if the letters fit."""
    if 5 * m <= NAME_BITS:
        return (h * _ODD & np.uint64((1 << 5 * m) - 1)).astype(np.int64)
    return ((h ^ h >> np.uint64(29)) * _ODD >> np.uint64(64 - NAME_BITS)).astype(np.int64)


def _folded(x: np.ndarray, m: int, k: int) -> np.ndarray:
    h = np.zeros(k, np.uint64)
    for j in range(m):
        h *= np.uint64(32) if 5 * m <= NAME_BITS else _BASE
        h += x[j : j + k]
    return h


def _places(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Where m letters stand that have a letter before or after them, and their names."""
    k = len(x) - m
    if k <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.cumsum(x == 0, dtype=np.int32)
    whole = ends[m - 1 : m - 1 + k] == np.r_[np.int32(0), ends[: k - 1]]
    pos = np.flatnonzero(whole)
    pos = pos[(x[pos - 1] > 0) | (x[pos + m] > 0)]
    return pos, _mixed(_folded(x, m, k)[pos], m)


def _entries(batches: Iterator[pa.RecordBatch], e: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, data): the distinct places with the letters before and after them (0 for none), packed."""
    m = e - 1
    same = np.sort(_mixed(_folded(np.repeat(np.arange(1, 27, dtype=np.uint8), m), m, 25 * m + 1)[::m], m))
    held: list[np.ndarray] = []

    def sent() -> pa.RecordBatch:
        keys = distinct(np.concatenate(held))
        name, codec = keys >> 10, pa.Codec("zstd", 1)
        bucket = name * buckets >> name_bits(m)
        edge = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(keys)]
        out = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            step = np.diff(name[a:b], prepend=name[a])
            kind = np.uint32 if int(step.max()) < 1 << 32 else np.uint64
            planes = step.astype(kind).view(np.uint8).reshape(b - a, -1).T.tobytes()
            both = keys[a:b] & 1023
            raw = planes + (both >> 5).astype(np.uint8).tobytes() + (both & 31).astype(np.uint8).tobytes()
            out.append(struct.pack("<qqq", b - a, name[a], len(raw)) + codec.compress(raw, asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "data"])

    size = 0
    for batch in batches:
        for x, _ in _parts(batch.column(0)):
            pos, name = _places(x, m)
            if not len(pos):
                continue
            before, after = x[pos - 1].astype(np.int64), x[pos + m].astype(np.int64)
            # a letter repeated through all e + 1 is a step from a mer to itself: no way on
            loop = np.flatnonzero(before == after)
            loop = loop[np.isin(name[loop], same) & (x[pos[loop]] == before[loop])]
            before[loop] = after[loop] = 0
            held.append(distinct(name << 10 | before << 5 | after))
            size += len(held[-1])
            if size >= SENT:
                yield sent()
                held.clear()
                size = 0
    if held:
        yield sent()


def _unpacked(data: bytes) -> np.ndarray:
    n, base, size = struct.unpack_from("<qqq", data)
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[24:], size), np.uint8)
    wide = size // n - 2
    step = np.ascontiguousarray(raw[: wide * n].reshape(wide, n).T).view(np.uint32 if wide == 4 else np.uint64).ravel()
    return base + np.cumsum(step.astype(np.int64)) << 10 | raw[wide * n : (wide + 1) * n].astype(np.int64) << 5 | raw[(wide + 1) * n :].astype(np.int64)


def _branching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name of the places that are not passed by all texts alike; all entries of a place are in one task."""
    by: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            by.setdefault(bucket, []).append(_unpacked(data.as_buffer().to_pybytes()))
    for held in by.values():
        keys = distinct(np.concatenate(held))
        begin = np.flatnonzero(np.diff(keys >> 10, prepend=-1))
        alone = np.diff(np.r_[begin, len(keys)]) == 1
        one = keys[begin]
        yield pa.RecordBatch.from_arrays([pa.array(one[~(alone & (one >> 5 & 31 > 0) & (one & 31 > 0))] >> 10)], ["name"])


def branches(texts: DataFrame, e: int) -> np.ndarray | None:
    """The sorted names of the branches of texts (one column); none if there are more than MOST_BRANCHES."""
    tasks = tasks_for(texts, 4)
    buckets = 8 * tasks
    sent = texts.mapInArrow(lambda it: _entries(it, e, buckets), "bucket int, data binary")
    found = written(sent.repartition(tasks, "bucket").mapInArrow(_branching, "name bigint"), "branches")
    try:
        return np.sort(found.toArrow().column(0).to_numpy()) if found.count() <= MOST_BRANCHES else None
    finally:
        forget(found)


class Cutter:
    """Finds branches; `seen` says of each beginning of a name whether a branch has it."""

    def __init__(self, names: np.ndarray, m: int):
        self.names, self.m = names, m
        self.shift = max(0, name_bits(m) - max(10, int(len(names)).bit_length() + 4))
        self.seen = np.zeros(1 << name_bits(m) - self.shift, bool)
        self.seen[names >> self.shift] = True

    def cut(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """start, stop, head, tail of the runs in letters with a 0 after each text: x[start : stop + m]."""
        pos, at = self.hits(x)
        go = np.flatnonzero(x[pos + self.m] > 0)
        return pos[go], pos[go + 1], at[go], at[go + 1]

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of branches and their numbers."""
        pos, name = _places(x, self.m)
        some = np.flatnonzero(self.seen[name >> self.shift])
        pos, name = pos[some], name[some]
        at = np.searchsorted(self.names, name)
        hit = self.names[np.minimum(at, len(self.names) - 1)] == name if len(self.names) else np.zeros(len(at), bool)
        return pos[hit], at[hit].astype(np.int32)


def strings(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The texts of letters 1-26."""
    ends = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(x[spread(start, size)] + np.uint8(64)))


def _planes(x: np.ndarray) -> bytes:
    return x.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _whole(raw: np.ndarray, n: int, k: int) -> np.ndarray:
    return np.ascontiguousarray(raw[4 * n * k : 4 * n * (k + 1)].reshape(4, n).T).view(np.int32).ravel()


class _Bag:
    """Distinct runs with their facts."""

    def __init__(self):
        self.held: list[tuple] = []
        self.letters = 0

    def add(self, text: pa.Array, *facts: np.ndarray) -> None:
        """facts: head, tail, cnt, first, last."""
        self.held.append((text, *facts))
        self.letters += len(text.buffers()[2] or b"")

    def merged(self) -> tuple:
        """Equal texts once, counts summed; in order of head."""
        coded = pa.concat_arrays([h[0] for h in self.held]).dictionary_encode()
        which, n = coded.indices.to_numpy(), len(coded.dictionary)
        head, tail, cnt, first, last = (np.concatenate([h[k] for h in self.held]) for k in range(1, 6))
        out = [np.empty(n, np.int32), np.empty(n, np.int32), np.bincount(which, cnt, n).astype(np.int64), np.zeros(n, bool), np.zeros(n, bool)]
        out[0][which], out[1][which] = head, tail
        out[3][which[first]] = out[4][which[last]] = True
        order = np.argsort(out[0], kind="stable")
        self.held, self.letters = [], 0
        return coded.dictionary.take(pa.array(order)), *(x[order] for x in out)


def _runs(batches: Iterator[pa.RecordBatch], shared, e: int, buckets: int, counted: tuple | None = None) -> Iterator[pa.RecordBatch]:
    """(bucket, data): the distinct runs with their facts, packed; all equal runs have one bucket. With `counted` (broadcast Counts and their length of mers) the count of a run's first short mer stands in place of its tail."""
    m, found, bag = e - 1, Cutter(shared.value, e - 1), _Bag()
    counter = Counter(counted[0].value, counted[1]) if counted else None

    def sent() -> pa.RecordBatch:
        text, head, *facts = bag.merged()
        bucket = head.astype(np.int64) * buckets // max(len(found.names), 1)
        data, offsets = _texts(text)
        size, codec = np.diff(offsets), pa.Codec("zstd", 1)
        edge = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(head)]
        out = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            tail, cnt, first, last = (x[a:b] for x in facts)
            high = cnt >> 31
            raw = b"".join([_planes(np.diff(head[a:b], prepend=0)), _planes(tail), _planes(cnt & 0x7FFFFFFF), _planes(high), _planes(size[a:b]), _planes(first + 2 * last), data[offsets[a] : offsets[b]].tobytes()])
            out.append(struct.pack("<qq", b - a, len(raw)) + codec.compress(raw, asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "data"])

    for batch in batches:
        for x, begin in _parts(batch.column(0)):
            start, stop, head, tail = found.cut(x)
            if not len(start):
                continue
            if counter:
                tail = counter.at(x)[start]
            coded = strings(x, start, stop - start + m).dictionary_encode()
            which, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            row = np.searchsorted(begin, start, "right")
            cnt = np.bincount(distinct(row << 32 | which) & 0xFFFFFFFF, minlength=n)
            ends = [np.empty(n, np.int32), np.empty(n, np.int32), np.zeros(n, bool), np.zeros(n, bool)]
            ends[0][which], ends[1][which] = head, tail
            ends[2][which[x[start - 1] == 0]] = True
            ends[3][which[x[stop + m] == 0]] = True
            bag.add(coded.dictionary, ends[0], ends[1], cnt, ends[2], ends[3])
            if bag.letters > 8 * LETTERS:
                yield sent()
    if bag.held:
        yield sent()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, head, tail, cnt, first, last; all rows of a bucket are in one task."""
    by: dict[int, _Bag] = {}
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            packed = data.as_buffer().to_pybytes()
            n, size = struct.unpack_from("<qq", packed)
            raw = np.frombuffer(pa.Codec("zstd").decompress(packed[16:], size), np.uint8)
            head, tail, low, high, letters, flags = (_whole(raw, n, k) for k in range(6))
            text = pa.StringArray.from_buffers(n, pa.py_buffer(np.r_[0, np.cumsum(letters)].astype(np.int32)), pa.py_buffer(raw[24 * n :].copy()))
            by.setdefault(bucket, _Bag()).add(text, np.cumsum(head, dtype=np.int64).astype(np.int32), tail, low + (high.astype(np.int64) << 31), flags & 1 > 0, flags & 2 > 0)
    for bag in by.values():
        text, *facts = bag.merged()
        yield pa.RecordBatch.from_arrays([text, *map(pa.array, facts)], ["text", "head", "tail", "cnt", "first", "last"])


def runs(texts: DataFrame, e: int) -> Runs | None:
    """The runs of texts (one column), as a written table; none if there are too many branches for a worker."""
    names = branches(texts, e)
    if names is None:
        return None
    shared, tasks = texts.sparkSession.sparkContext.broadcast(names), tasks_for(texts)
    buckets = 8 * tasks
    sent = texts.mapInArrow(lambda it: _runs(it, shared, e, buckets), "bucket int, data binary").repartition(tasks, "bucket")
    table = written(sent.mapInArrow(_merged, "text string, head int, tail int, cnt bigint, first boolean, last boolean"), "runs")
    shared.destroy()  # each copy is a file
    return Runs(table, e, names)


def _windows(batches: Iterator[pa.RecordBatch], width: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _texts(batch.column(0))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + LETTERS // 4, "right")) - 1)
            n = np.maximum(np.diff(offsets[a : b + 1]) - width + 1, 0)
            at, which = spread(offsets[a:b], n), np.repeat(np.arange(a, b), n)
            if len(at):
                cut = np.lib.stride_tricks.sliding_window_view(data, width)[at]
                mer = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(cut)))
                taken = pa.array(which)
                yield pa.RecordBatch.from_arrays([*(batch.column(1 + k).take(taken) for k in range(len(keep))), mer, pa.array((at - offsets[which]).astype(np.int32))], [*keep, "mer", "off"])
            a = b


def windows(table: DataFrame, width: int, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep`, mer, off: one row for each `width` letters of each text."""
    keep = keep or []
    kinds = {c: k for c, k in table.dtypes}
    return table.select("text", *keep).mapInArrow(lambda it: _windows(it, width, keep), ", ".join([*(f"{c} {kinds[c]}" for c in keep), "mer string", "off int"]))


class Solved(NamedTuple):
    """What a search over the branches gives: place (steps from the first node to the last mers before a branch, at least), value and width (the best sum, and the largest least count, on forward ways to it), down and up (whether a forward way from the first node, to the last node, passes it), nin and nout (runs to and from it); and place, value and width of the last node, -1 if it is not reached."""

    place: np.ndarray
    value: np.ndarray
    width: np.ndarray
    down: np.ndarray
    up: np.ndarray
    nin: np.ndarray
    nout: np.ndarray
    end: tuple[int, int, int]


class Links:
    """The runs as numbers: from branch `head` to branch `tail` over n mers."""

    def __init__(self, head, tail, n, cnt, first, last, branches: int):
        self.head, self.tail, self.n, self.cnt, self.first, self.last, self.branches = head, tail, n, cnt, first, last, branches
        self.place = self._searched()
        self.lead = np.where(first, 1, self.place[head].astype(np.int64) + 1).astype(np.int32)
        self.stop = self.lead + n - 1
        # of the mers before a branch only those reached first lead up a level
        self.forward = self.stop == self.place[tail]

    def _searched(self) -> np.ndarray:
        far = np.iinfo(np.int32).max // 2
        place = np.full(self.branches, far, np.int32)
        order = np.argsort(self.head, kind="stable")
        begin = np.searchsorted(self.head[order], np.arange(self.branches + 1))
        np.minimum.at(place, self.tail[self.first], self.n[self.first])
        changed = np.unique(self.tail[self.first])
        while len(changed):
            out = order[spread(begin[changed], begin[changed + 1] - begin[changed])]
            out = out[~self.first[out]]
            to, way = self.tail[out], place[self.head[out]] + self.n[out]
            better = way < place[to]
            to = to[better]
            np.minimum.at(place, to, way[better])
            changed = np.unique(to)
        return place

    def rounds(self, some: np.ndarray) -> Iterator[np.ndarray]:
        """The runs `some` in groups by rising level of their last mers."""
        at = np.flatnonzero(some)
        at = at[np.argsort(self.stop[at], kind="stable")]
        yield from np.split(at, np.flatnonzero(np.diff(self.stop[at])) + 1) if len(at) else ()

    def best(self, cnt: np.ndarray, widest: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For each branch and each run the best sum of counts up to its end (with `widest` the largest least count)."""
        at, own = np.full(self.branches, -1, np.int64), np.empty(len(cnt), np.int64)
        for group in self.rounds(np.ones(len(cnt), bool)):
            before = np.where(self.first[group], 999_999 if widest else 0, at[self.head[group]])
            own[group] = np.minimum(before, cnt[group]) if widest else before + cnt[group] * self.n[group]
            ahead = group[self.forward[group]]
            np.maximum.at(at, self.tail[ahead], own[ahead])
        return at, own

    def alive(self, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a forward way of runs that are not gone leads from the first node to each branch, and from it to the last node."""
        down, up = np.zeros(self.branches, bool), np.zeros(self.branches, bool)
        for group in self.rounds(self.forward & ~gone):
            down[self.tail[group[self.first[group] | down[self.head[group]]]]] = True
        for group in reversed(list(self.rounds(~gone & ~self.first))):
            up[self.head[group[self.last[group] | self.forward[group] & up[self.tail[group]]]]] = True
        return down, up

    def best_way(self, cnt: np.ndarray, code: np.ndarray) -> list[int]:
        """The runs of a best way: from the end back, always the best run whose last mer (in the order of `code`) is the smallest."""
        at, own = self.best(cnt)
        ends = np.flatnonzero(self.last)
        if not len(ends):
            raise ValueError("END can't be reached from BEGIN")
        ends = ends[own[ends] == own[ends].max()]
        way = [int(ends[np.argmin(code[ends])])]
        order = np.argsort(self.tail, kind="stable")
        begin = np.searchsorted(self.tail[order], np.arange(self.branches + 1))
        while not self.first[way[-1]]:
            v = self.head[way[-1]]
            into = order[begin[v] : begin[v + 1]]
            into = into[self.forward[into] & (own[into] == at[v])]
            way.append(int(into[np.argmin(code[into])]))
        return way[::-1]


def _loaded(batches: Iterator[pa.RecordBatch], branches: int) -> tuple[Links, pa.Table]:
    """Columns head, tail, n, cnt, first, last as Links, and the others."""
    batches = list(batches)
    table = pa.Table.from_batches(batches) if batches else None
    if table is None:
        none = np.empty(0, np.int32)
        return Links(none, none, none, none.astype(np.int64), none.astype(bool), none.astype(bool), branches), pa.table({"gone": pa.array([], pa.bool_()), "text": pa.array([], pa.string())})
    cols = [table.column(c).to_numpy() for c in ("head", "tail", "n", "cnt", "first", "last")]
    return Links(*cols, branches), table


PIECE = 1 << 25


def _sent(name: str, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    raw = values.tobytes()
    for k in range(0, max(len(raw), 1), PIECE):
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([raw[k : k + PIECE]], pa.binary())], ["name", "at", "data"])


def _solved(batches: Iterator[pa.RecordBatch], branches: int) -> Iterator[pa.RecordBatch]:
    links, table = _loaded(batches, branches)
    value, total = links.best(links.cnt)
    width, least = links.best(links.cnt, True)
    down, up = links.alive(table.column("gone").to_numpy())
    ends = links.last
    end = (int(links.stop[ends].min()) + 1, int(total[ends].max()), int(least[ends].max())) if ends.any() else (-1, -1, -1)
    degrees = (np.bincount(x, minlength=branches).astype(np.int32) for x in (links.tail, links.head))
    for name, x in zip(Solved._fields, (links.place, value, width, down, up, *degrees, np.array(end, np.int64)), strict=True):
        yield from _sent(name, x)


def _numbers(found: Runs, *more) -> DataFrame:
    """The runs as numbers, in one partition: one task takes them all."""
    return found.table.select("head", "tail", (F.length("text") - (found.e - 1)).cast("int").alias("n"), "cnt", "first", "last", *more).coalesce(1)


def solved(found: Runs, gone=None) -> Solved:
    """The search over all runs, in one task; runs where `gone` holds are left out of down and up."""
    branches = found.branches
    out: dict[str, list[tuple[int, bytes]]] = {}
    for r in _numbers(found, (F.lit(False) if gone is None else gone).alias("gone")).mapInArrow(lambda it: _solved(it, branches), "name string, at bigint, data binary").collect():
        out.setdefault(r["name"], []).append((r["at"], bytes(r["data"])))
    kinds = {"place": np.int32, "down": bool, "up": bool, "nin": np.int32, "nout": np.int32}
    whole = {k: np.frombuffer(b"".join(x for _, x in sorted(v)), kinds.get(k, np.int64)) for k, v in out.items()}
    return Solved(**{**whole, "end": tuple(int(x) for x in whole["end"])})


def _looked_up(batches: Iterator[pa.RecordBatch], shared: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        head, tail = (batch.column(k).to_numpy() for k in (1, 2))
        extra = {f"{end}_{name}": pa.array(x.value[at]) for name, x in shared.items() for end, at in (("head", head), ("tail", tail))}
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], [*batch.schema.names, *extra])


def looked_up(found: Runs, arrays: dict[str, np.ndarray]) -> DataFrame:
    """The runs with head_x and tail_x for each named array x of values of the branches, and n, lead, stop (levels of their first and last mers) if `place` is among these."""
    table, spark = found.table, found.table.sparkSession
    shared = {k: spark.sparkContext.broadcast(x) for k, x in arrays.items()}
    kind = {"i": {4: "int", 8: "bigint"}, "b": {1: "boolean"}}
    fields = ", ".join([*(f"{c} {k}" for c, k in table.dtypes), *(f"{end}_{k} {kind[x.dtype.kind][x.dtype.itemsize]}" for k, x in arrays.items() for end in ("head", "tail"))])
    more = table.mapInArrow(lambda it: _looked_up(it, shared), fields).withColumn("n", F.length("text") - (found.e - 1))
    if "place" not in arrays:
        return more
    lead = F.when(F.col("first"), 1).otherwise(F.col("head_place") + 1).cast("int")
    return more.withColumn("lead", lead).withColumn("stop", (F.col("lead") + F.col("n") - 1).cast("int"))


def _ways(batches: Iterator[pa.RecordBatch], branches: int, e: int, choose: Callable) -> Iterator[pa.RecordBatch]:
    links, table = _loaded(batches, branches)
    text = table.column("text")
    code = np.zeros(len(links.n), np.int64)
    at = 0
    for chunk in text.chunks if len(text) else []:
        data, offsets = _texts(chunk)
        for j in range(e):
            code[at : at + len(chunk)] = code[at : at + len(chunk)] << 5 | (data[offsets[1:] - e + j] - np.uint8(64)).astype(np.int64)
        at += len(chunk)
    ways = choose(links, code)
    whole = ["".join([text[w[0]].as_py()[: e - 1], *(text[k].as_py()[e - 1 :] for k in w)]) for w in ways]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(whole)), pa.int32()), pa.array(whole, pa.string())], ["path_id", "text"])


def complementary(links: Links, code: np.ndarray, m: int) -> list[list[int]]:
    """Up to m ways, each best for what those before leave uncovered; as paths.complementary_ways() without fixed ways and extra turns."""
    ways, left = [], links.cnt.copy()
    for _ in range(m):
        way = links.best_way(left, code)
        if not (left[way] * links.n[way]).any():
            break
        ways.append(way)
        left[way] = 0
    return ways


def complementary_texts(found: Runs, m: int) -> DataFrame:
    """path_id, text of up to m complementary ways through the forward graph."""
    branches, e = found.branches, found.e
    return _numbers(found, "text").mapInArrow(lambda it: _ways(it, branches, e, lambda links, code: complementary(links, code, m)), "path_id int, text string")


def _mer(end: str, e: int):
    """The first (last) mer of a run."""
    return F.substring("text", 1, e) if end == "first" else F.right(F.col("text"), F.lit(e))


def _rows(found: Runs, rows: list[tuple], schema: str) -> DataFrame:
    return found.table.sparkSession.createDataFrame(rows, schema)


def _inner(table: DataFrame, e: int, keep: list[str] | None = None) -> DataFrame:
    """src, dst, off and the columns `keep` of the edges within runs."""
    return windows(table, e + 1, keep).select(F.left("mer", F.lit(e)).alias("src"), F.right("mer", F.lit(e)).alias("dst"), "off", *(keep or []))


def _crossing(before: DataFrame, after: DataFrame, e: int, keep: list[str] | None = None) -> DataFrame:
    """src, dst and a_x, b_x of the columns `keep` of the edges from run to run."""
    a = before.select(F.col("tail").alias("_v"), F.left(_mer("last", e), F.lit(1)).alias("_c"), *(F.col(c).alias(f"a_{c}") for c in keep or []))
    b = after.select(F.col("head").alias("_v"), _mer("first", e).alias("dst"), *(F.col(c).alias(f"b_{c}") for c in keep or []))
    # the last mer of one run is a letter before the first e - 1 letters of the next
    both = a.join(b, "_v").withColumn("src", F.concat("_c", F.left("dst", F.lit(e - 1)))).where("src <> dst")
    return both.select("src", "dst", *(f"{x}_{c}" for x in "ab" for c in keep or []))


def nodes(found: Runs) -> DataFrame:
    """mer, cnt of all nodes but the first and the last."""
    return windows(found.table, found.e, ["cnt"]).select("mer", "cnt")


def nodes_of(found: Runs, mers: list[str]) -> DataFrame:
    """nodes() of the given mers (a few)."""
    holds = reduce(lambda a, b: a | b, (F.contains("text", F.lit(m)) for m in mers), F.lit(False))
    return windows(found.table.where(holds), found.e, ["cnt"]).select("mer", "cnt").where(F.col("mer").isin(mers))


def levels(found: Runs) -> DataFrame:
    """mer, ppos, as graph.levels()."""
    s = solved(found)
    inner = windows(looked_up(found, {"place": s.place}), found.e, ["lead"]).select("mer", (F.col("lead") + F.col("off")).cast("int").alias("ppos"))
    return inner.unionByName(_rows(found, [(BEGIN, 0), *([(END, s.end[0])] if s.end[0] > 0 else [])], "mer string, ppos int"))


def _forward(placed: DataFrame, e: int) -> DataFrame:
    """src, dst of the edges of placed runs that lead up a level, and those to END."""
    inner = _inner(placed, e).select("src", "dst")
    across = _crossing(placed.where("stop = tail_place"), placed.where("not first"), e)
    begins = placed.where("first").select(F.lit(BEGIN).alias("src"), _mer("first", e).alias("dst"))
    ends = placed.where("last").select(_mer("last", e).alias("src"), F.lit(END).alias("dst"))
    return inner.unionByName(across).unionByName(begins).unionByName(ends)


def forward(found: Runs) -> DataFrame:
    """src, dst, as graph.forward()."""
    return _forward(written(looked_up(found, {"place": solved(found).place}), "placed"), found.e)


def trimmed(found: Runs, gone) -> DataFrame:
    """The forward edges on a way from BEGIN to END through no run where `gone` holds: a run with a mer that is gone has no other mer on such a way."""
    s = solved(found, gone)
    placed = looked_up(found, {"place": s.place, "down": s.down, "up": s.up}).where(~gone)
    return _forward(written(placed.where("(first or head_down) and (last or stop = tail_place and tail_up)"), "alive"), found.e)


def costs(found: Runs) -> DataFrame:
    """src, dst, ca, cb, nin_a, nout_a, nin_b, nout_b, pa, pb: counts, degrees and levels of both ends of all edges."""
    s, e = solved(found), found.e
    loop = F.when(F.expr("n = 1 and head = tail"), 1).otherwise(0)
    degree = lambda c, end: (F.col(c) + F.col(end).cast("int") - loop).cast("bigint")
    t = written(looked_up(found, {"place": s.place, "nin": s.nin, "nout": s.nout}).withColumn("into", degree("head_nin", "first")).withColumn("out", degree("tail_nout", "last")).drop("head_nin", "head_nout", "tail_nin", "tail_nout", "head_place", "tail_place"), "placed")
    begun, ended = (t.where(end).count() for end in ("first", "last"))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    fields = ["ca", "cb", "nin_a", "nout_a", "nin_b", "nout_b", "pa", "pb"]

    def edges(df: DataFrame, *values) -> DataFrame:
        return df.select("src", "dst", *(v.alias(name) for v, name in zip(values, fields, strict=True)))

    at, alone = F.col("lead") + F.col("off"), F.col("n") == 1
    first_out = F.when(alone, F.col("out")).otherwise(one)
    last_in = F.when(alone, F.col("into")).otherwise(one)
    inner = edges(_inner(t, e, ["cnt", "n", "into", "out", "lead"]), F.col("cnt"), F.col("cnt"), F.when(F.col("off") == 0, F.col("into")).otherwise(one), one, one, F.when(F.col("off") + 2 == F.col("n"), F.col("out")).otherwise(one), at, at + 1)
    both = _crossing(t.withColumn("near", last_in), t.withColumn("near", first_out), e, ["cnt", "into", "out", "lead", "stop", "near"])
    across = edges(both, F.col("a_cnt"), F.col("b_cnt"), F.col("a_near"), F.col("a_out"), F.col("b_into"), F.col("b_near"), F.col("a_stop"), F.col("b_lead"))
    begins = edges(t.where("first").select("*", F.lit(BEGIN).alias("src"), _mer("first", e).alias("dst")), zero, F.col("cnt"), zero, F.lit(begun).cast("bigint"), F.col("into"), first_out, F.lit(0), F.col("lead"))
    ends = edges(t.where("last").select("*", _mer("last", e).alias("src"), F.lit(END).alias("dst")), F.col("cnt"), zero, last_in, F.col("out"), F.lit(ended).cast("bigint"), zero, F.col("stop"), F.lit(s.end[0]))
    return inner.unionByName(across).unionByName(begins).unionByName(ends)


def values(found: Runs) -> DataFrame:
    """mer, value: the best sum of counts on a forward way from BEGIN to each node."""
    s = solved(found)
    t = looked_up(found, {"value": s.value}).withColumn("before", F.when(F.col("first"), F.lit(0)).otherwise(F.col("head_value")).cast("bigint"))
    inner = windows(t, found.e, ["before", "cnt"]).select("mer", (F.col("before") + F.col("cnt") * (F.col("off") + 1)).alias("value"))
    return inner.unionByName(_rows(found, [(BEGIN, 0), *([(END, s.end[1])] if s.end[1] >= 0 else [])], "mer string, value bigint"))


def complementary_facts(found: Runs, m: int) -> DataFrame:
    """paths.way_facts() of m complementary ways, each held against the forward edges themselves."""
    texts = written(complementary_texts(found, m), "ways")
    steps = windows(texts, found.e, ["path_id"]).select("path_id", F.col("off").alias("step"), "mer")
    steps = written(steps, "steps")
    held = steps.select("mer").distinct()
    ends = held.unionByName(_rows(found, [(BEGIN,), (END,)], "mer string"))
    near = forward(found).join(F.broadcast(ends.withColumnRenamed("mer", "src")), "src", "left_semi").join(F.broadcast(ends.withColumnRenamed("mer", "dst")), "dst", "left_semi")
    return way_facts(steps, nodes(found).join(F.broadcast(held), "mer", "left_semi"), written(near.select("src", "dst"), "near"))


class Counts(NamedTuple):
    """What a worker needs to give every mer of a text its count: the names of branches, and for the runs in order of their first branch where those of each branch begin, the letter after the branch, and the count."""

    names: np.ndarray
    begin: np.ndarray
    letter: np.ndarray
    cnt: np.ndarray


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held) if (held := list(batches)) else None
    keys, cnt = (np.empty(0, np.int64),) * 2 if table is None else (table.column(c).to_numpy() for c in ("key", "cnt"))
    order = np.argsort(keys)
    yield from _sent("keys", keys[order])
    yield from _sent("cnt", cnt[order])


def counts(found: Runs) -> Counts:
    letter = F.ascii(F.substring("text", found.e, 1)) - 64
    rows = found.table.select((F.col("head").cast("bigint") * 32 + letter).alias("key"), "cnt").coalesce(1).mapInArrow(_keyed, "name string, at bigint, data binary").collect()
    whole = {name: np.frombuffer(b"".join(bytes(r["data"]) for r in sorted(rows, key=lambda r: r["at"]) if r["name"] == name), np.int64) for name in ("keys", "cnt")}
    begin = np.searchsorted(whole["keys"] >> 5, np.arange(found.branches + 1)).astype(np.int32)
    cnt = whole["cnt"]
    return Counts(found.names, begin, (whole["keys"] & 31).astype(np.uint8), cnt.astype(np.int32) if cnt.max(initial=0) < 1 << 31 else cnt)


class Counter:
    """The counts of the mers of texts."""

    def __init__(self, given: Counts, e: int):
        self.given, self.e, self.found = given, e, Cutter(given.names, e - 1)
        self.keys = np.repeat(np.arange(len(given.names)), np.diff(given.begin)) << 5 | given.letter

    def at(self, x: np.ndarray, begin: np.ndarray | None = None, lead: np.ndarray | None = None) -> np.ndarray:
        """For each place of letters with a 0 after each text the count of the mer there (nothing of use where none begins). A text that begins within a run needs the count of its first mer in `lead`."""
        pos, at = self.found.hits(x)
        on = x[pos + self.e - 1] > 0
        pos, key = pos[on], at[on].astype(np.int64) * 32 + x[pos[on] + self.e - 1]
        value = self.given.cnt[np.searchsorted(self.keys, key)]
        own = np.zeros(len(x), np.int64)
        known = np.zeros(len(x), bool)
        known[:1] = True
        if lead is not None:
            own[begin], known[begin] = lead, True
        own[pos], known[pos] = value, True
        where = np.flatnonzero(known)
        return np.repeat(own[where], np.diff(np.r_[where, len(x)]))


class Pool(NamedTuple):
    """All distinct mers of k letters of some texts: runs of these (text, tail = the count of the first mer of e letters), and the counts of mers of e letters."""

    table: DataFrame
    counts: object
    k: int
    e: int


def pool(texts: DataFrame, k: int, found: Runs) -> Pool | None:
    """The mers of k letters of the texts of `found`, by runs of their own; none if there are too many branches for a worker."""
    long = branches(texts, k)
    if long is None:
        return None
    spark, e = texts.sparkSession, found.e
    shared, whole = spark.sparkContext.broadcast(long), spark.sparkContext.broadcast(counts(found))
    tasks = tasks_for(texts, 4)
    sent = texts.mapInArrow(lambda it: _runs(it, shared, k, 8 * tasks, (whole, e)), "bucket int, data binary").repartition(tasks, "bucket")
    table = written(sent.mapInArrow(_merged, "text string, head int, tail int, cnt bigint, first boolean, last boolean").select("text", F.col("tail").alias("lead")), "pool")
    shared.destroy()
    return Pool(table, whole, k, e)


def _codes(x: np.ndarray, m: int, size: int) -> np.ndarray:
    """Five bits for each of m letters at each of the first `size` places; letters beyond the end are 0."""
    x = np.r_[x, np.zeros(m, np.uint8)]
    h = np.zeros(size, np.int64)
    for j in range(m):
        h = h << 5 | x[j : j + size]
    return h


def _code(text: str) -> int:
    return sum(ord(c) - 64 << 5 * (len(text) - 1 - j) for j, c in enumerate(text))


def _scores(batches: Iterator[pa.RecordBatch], shared, k: int, e: int, covered: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Letters, places of the mers of k letters, their scores, and the counts of the mers of e letters at all places; covered ones count 0."""
    counter, out = Counter(shared.value, e), np.array([_code(c) for c in covered], np.int64)
    for batch in batches:
        done = 0
        for x, begin in _parts(batch.column(0)):
            n = len(begin)
            cnt = counter.at(x, begin, batch.column(1).to_numpy()[done : done + n])
            done += n
            code = _codes(x, e, len(x))
            if len(out):
                cnt = np.where(np.isin(code, out), 0, cnt)
            # how far before stands the same mer: within k letters it counts once
            since = np.full(len(x), k, np.int64)
            for d in range(k - e, 0, -1):
                since[d:][code[d:] == code[:-d]] = d
            size = np.diff(np.r_[begin, len(x)]) - k
            at = spread(begin, size)
            score = np.zeros(len(at), np.int64)
            for j in range(k - e + 1):
                score += np.where(since[at + j] > j, cnt[at + j], 0)
            yield x, at, score, cnt


def _letters(x: np.ndarray, at: np.ndarray, k: int) -> pa.Array:
    return strings(x, at, np.full(len(at), k))


def _reduced(held: Pool, covered: list[str], make: Callable, schema: str) -> DataFrame:
    """make(x, at, score, cnt) for each part of the pool: a dictionary of columns, or nothing."""
    shared, k, e = held.counts, held.k, held.e

    def run(batches):
        for part in _scores(batches, shared, k, e, covered):
            if got := make(*part):
                yield pa.RecordBatch.from_pydict(got)

    return held.table.mapInArrow(run, schema)


def pool_scores(held: Pool, least: int = 0, most: int | None = None) -> DataFrame:
    """kmer, score of the pool, as greedy.scores(); only scores from `least` to `most`."""
    k = held.k

    def make(x, at, score, cnt):
        on = score >= least if most is None else (score >= least) & (score <= most)
        return {"kmer": _letters(x, at[on], k), "score": pa.array(score[on])}

    return _reduced(held, [], make, "kmer string, score bigint")


def pool_quarter(held: Pool) -> DataFrame:
    """kmer, score: the quarter with the highest scores (ties by mer), as greedy.best_quarter(), without an order of all."""

    def tallied(x, at, score, cnt):
        values, n = np.unique(score, return_counts=True)
        return {"score": pa.array(values), "n": pa.array(n)}

    hist = [tuple(r) for r in _reduced(held, [], tallied, "score bigint, n bigint").groupBy("score").agg(F.sum("n")).orderBy(F.desc("score")).collect()]
    want, above, edge = sum(n for _, n in hist) // 4, 0, None
    for score, n in hist:
        if above + n > want:
            edge = score
            break
        above += n
    if edge is None:
        return pool_scores(held)
    ties = pool_scores(held, edge, edge)
    last, left = "", want - above
    # the beginning of the last of the ties that are taken, some letters at a time
    for size in range(4, held.k, 4):
        groups = ties.where(F.startswith("kmer", F.lit(last))).groupBy(F.left("kmer", F.lit(size)).alias("begin")).count().orderBy("begin")
        for begin, n in (tuple(r) for r in groups.toLocalIterator()):
            if n > left:
                last = begin
                break
            left -= n
    inside = ties.where(F.startswith("kmer", F.lit(last))).orderBy("kmer").limit(left)
    return pool_scores(held, edge + 1).unionByName(ties.where(F.left("kmer", F.lit(len(last))) < last)).unionByName(inside)


def pool_best(held: Pool, covered: list[str]) -> tuple[str, int] | None:
    """The mer with the largest sum of counts of mers that are not covered (ties by mer), and the sum."""
    k = held.k

    def make(x, at, score, cnt):
        at = at[score == score.max()] if len(at) else at
        return {"kmer": [min(_letters(x, at, k).to_pylist())], "score": [int(score.max())]} if len(at) else None

    row = _reduced(held, covered, make, "kmer string, score bigint").orderBy(F.desc("score"), "kmer").first()
    return None if row is None else (row["kmer"], row["score"])


def pool_gain(held: Pool, covered: list[str], kmer: str) -> int:
    """The sum of the counts of the mers of a mer of the pool that are not covered."""
    k, wanted = held.k, _code(kmer[:7]) << 5 | ord(kmer[7]) - 64
    rest = _code(kmer[8:])

    def make(x, at, score, cnt):
        some = at[_codes(x, 8, len(x))[at] == wanted]
        some = some[_codes(x, k - 8, len(x))[some + 8] == rest]
        return {"score": [int(score[np.searchsorted(at, some[0])])]} if len(some) else None

    row = _reduced(held, covered, make, "score bigint").first()
    return 0 if row is None else row["score"]


def pool_greedy(held: Pool, n: int, given: list[str] | None = None) -> list[tuple[str, int]]:
    """greedy.greedy() over a pool: a pass over its runs for each pick."""
    picks, covered = [], []
    for turn in range(n):
        if turn < len(given or []):
            pick = given[turn], pool_gain(held, covered, given[turn])
        elif (pick := pool_best(held, covered)) is None:
            break
        picks.append(pick)
        covered += [pick[0][j : j + held.e] for j in range(held.k - held.e + 1)]
    return picks


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return h << np.uint64(bits) | h >> np.uint64(64 - bits)


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def hashed(x: np.ndarray, size: int, k: int, seed: int) -> np.ndarray:
    """Spark's xxhash64(seed, text) of the k letters (below 32) at each of the first `size` places; the letters of all must end in x."""
    raw = x + np.uint8(64)
    first = np.array([42 + 4], np.uint64) + _P5 ^ np.array([seed], np.int32).view(np.uint32).astype(np.uint64) * _P1
    h = np.repeat(_finished(_turned(first, 23) * _P2 + _P3) + _P5 + np.uint64(k), size)
    j = 0
    while j + 8 <= k:
        h = _turned(h ^ _turned(np.ndarray(size, "<u8", raw, j, (1,)) * _P2, 31) * _P1, 27) * _P1 + _P4
        j += 8
    if j + 4 <= k:
        h = _turned(h ^ np.ndarray(size, "<u4", raw, j, (1,)).astype(np.uint64) * _P1, 23) * _P2 + _P3
        j += 4
    for j in range(j, k):
        h = _turned(h ^ raw[j : j + size].astype(np.uint64) * _P5, 11) * _P1
    return _finished(h).view(np.int64)


def _summed(x: np.ndarray, cnt: np.ndarray, k: int, e: int) -> np.ndarray:
    """For each place where k letters fit the sum of the counts of the mers of e letters in these, each once; of use where the k letters are of one text."""
    whole, n = np.r_[0, np.cumsum(cnt)], k - e + 1
    score = whole[n : len(x) - k + 1 + n] - whole[: len(x) - k + 1]
    met = np.zeros(len(x), bool)
    for d in range(1, n):
        # a mer that stood d letters before, and not nearer, counts once in what holds both
        same = np.r_[0, np.cumsum(x[d:] == x[:-d], dtype=np.int32)]
        again = np.flatnonzero(same[e:] - same[:-e] == e) + d
        again = again[~met[again]]
        met[again] = True
        for w in range(d, n):
            at = again - w
            on = (at >= 0) & (at < len(score))
            score[at[on]] -= cnt[again[on]]
    return score


class _Kept:
    """The `most` distinct mers of k letters of the smallest ranks (ties by mer), with the counts of the mers of e letters in each."""

    def __init__(self, most: int, k: int, e: int):
        self.most, self.k, self.n = most, k, k - e + 1
        self.rank, self.mer, self.cnt = np.empty(0, np.int64), np.empty((0, 2), np.int64), np.empty((0, self.n), np.int64)

    def add(self, x: np.ndarray, cnt: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        if len(self.rank) == self.most:
            last = self.rank[-1]
        else:  # mers of different ranks are different ones
            ranks = distinct(rank.copy())
            last = ranks[min(self.most, len(ranks)) - 1]
        at, rank = at[rank <= last], rank[rank <= last]
        half = self.k // 2
        mer = np.stack([reduce(lambda h, j: h << 5 | x[at + j], part, np.zeros(len(at), np.int64)) for part in (range(half), range(half, self.k))], 1)
        # equal mers have equal ranks
        order = np.lexsort((mer[:, 1], mer[:, 0], rank))
        new = np.r_[True, (mer[order[1:]] != mer[order[:-1]]).any(1)] if len(order) else np.empty(0, bool)
        order = order[new][: self.most]
        rank, mer, own = (np.concatenate(p) for p in ((self.rank, rank[order]), (self.mer, mer[order]), (self.cnt, cnt[at[order][:, None] + np.arange(self.n)])))
        order = np.lexsort((mer[:, 1], mer[:, 0], rank))
        new = np.r_[True, (mer[order[1:]] != mer[order[:-1]]).any(1)] if len(order) else np.empty(0, bool)
        order = order[new][: self.most]
        self.rank, self.mer, self.cnt = rank[order], mer[order], own[order]

    def rows(self, drawn: bool) -> pa.RecordBatch:
        half = self.k // 2
        letters = np.empty((len(self.mer), self.k), np.uint8)
        for j in range(self.k):
            letters[:, j] = self.mer[:, int(j >= half)] >> 5 * ((half if j < half else self.k) - 1 - j) & 31
        ends = pa.array(np.arange(len(self.mer) + 1, dtype=np.int32) * np.int32(self.n))
        kmer = strings(letters.ravel(), np.arange(len(self.mer)) * self.k, np.full(len(self.mer), self.k))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(self.mer), drawn)), pa.array(self.rank), kmer, pa.ListArray.from_arrays(ends, pa.array(self.cnt.ravel()))], ["drawn", "rank", "kmer", "cnt"])


def _surveyed(batches: Iterator[pa.RecordBatch], shared, k: int, e: int, covered: list[str], most: int, seed: int, draws: int) -> Iterator[pa.RecordBatch]:
    """The mers of k letters of the largest scores, of mers that are not covered, and (drawn) those of the smallest hashes."""
    counter, out = Counter(shared.value, e), np.array([_code(c) for c in covered], np.int64)
    top, drawn = _Kept(most, k, e), _Kept(draws, k, e)
    for batch in batches:
        for x, begin in _parts(batch.column(0)):
            at = spread(begin, np.maximum(np.diff(np.r_[begin, len(x)]) - k, 0))
            if not len(at):
                continue
            cnt = counter.at(x)
            left = np.where(np.isin(_codes(x, e, len(x)), out), 0, cnt) if len(out) else cnt
            top.add(x, cnt, at, -_summed(x, left, k, e)[at])
            if draws:
                drawn.add(x, cnt, at, hashed(x, len(x) - k + 1, k, seed)[at])
    yield from (kept.rows(kind) for kept, kind in ((top, False), (drawn, True)) if len(kept.rank))


class Heads:
    """Long mers of texts for greedy picks. One pass over the texts finds those of the largest scores; scores only sink as mers are covered, so the texts are passed again only where the best of them falls behind the last that is held."""

    def __init__(self, texts: DataFrame, k: int, found: Runs, most: int = MOST_HEADS, seed: int = 1, draws: int = MOST_DRAWN):
        self.texts, self.k, self.e, self.found, self.most, self.seed, self.draws = texts, k, found.e, found, most, seed, draws
        self.counts = texts.sparkSession.sparkContext.broadcast(counts(found))
        self.cnt: dict[str, int] = {}
        self.pool: set[str] = set()
        self.top, self.some = self.survey([], most, seed, draws)

    def mers(self, kmer: str) -> list[str]:
        return [kmer[j : j + self.e] for j in range(self.k - self.e + 1)]

    def survey(self, covered: list[str], most: int, seed: int = 1, draws: int = 0) -> tuple[list[tuple[str, int]], list[str]]:
        """(kmer, score) of the largest scores in order, and the mers that are drawn."""
        shared, k, e = self.counts, self.k, self.e
        found = written(self.texts.mapInArrow(lambda it: _surveyed(it, shared, k, e, covered, most, seed, draws), "drawn boolean, rank bigint, kmer string, cnt array<bigint>"), "heads")
        out = []
        for drawn, n in ((False, most), (True, draws)):
            rows = found.where(F.col("drawn") == drawn).dropDuplicates(["kmer"]).orderBy("rank", "kmer").limit(n).collect() if n else []
            for r in rows:
                self.pool.add(r["kmer"])
                self.cnt.update(zip(self.mers(r["kmer"]), r["cnt"], strict=True))
            out.append([(r["kmer"], -r["rank"]) for r in rows])
        forget(found)
        return out[0], [m for m, _ in out[1]]

    def drawn(self, seed: int, n: int) -> list[str]:
        """n mers by their hash."""
        return self.some[:n] if seed == self.seed and n <= self.draws else self.survey([], 1, seed, n)[1]

    def gain(self, kmer: str, covered: set[str]) -> int:
        return sum(self.cnt[m] for m in set(self.mers(kmer)) - covered)

    def holds(self, kmer: str) -> bool:
        """Whether the texts hold a mer; if so its counts are known from then on."""
        if kmer not in self.pool and not self.texts.where(F.contains("seq", F.lit(kmer))).isEmpty():
            self.cnt.update({m: c for m, c in nodes_of(self.found, self.mers(kmer)).collect()})
            self.pool.add(kmer)
        return kmer in self.pool

    def best(self, covered: set[str]) -> tuple[str, int] | None:
        """The mer with the largest sum of counts of mers that are not covered (ties by mer), and the sum."""
        score, kmer = min(((-self.gain(m, covered), m) for m, _ in self.top), default=(0, ""))
        if self.top and len(self.top) == self.most and (score, kmer) > (-self.top[-1][1], self.top[-1][0]):
            return self.survey(sorted(covered), 1)[0][0]
        return (kmer, -score) if self.top else None


def head_greedy(heads: Heads, n: int, given: list[str] | None = None) -> list[tuple[str, int]]:
    """greedy.greedy() over the texts themselves."""
    picks, covered = [], set()
    for turn in range(n):
        if turn < len(given or []):
            pick = given[turn], heads.gain(given[turn], covered) if heads.holds(given[turn]) else 0
        elif (pick := heads.best(covered)) is None:
            break
        picks.append(pick)
        covered.update(heads.mers(pick[0]) if pick[0] in heads.pool else [])
    return picks
