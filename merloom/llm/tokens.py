"""Token ids of a public byte-level BPE, by speculation and verification.

A text is cut into units (white space and what follows it), a unit into words by the tokenizer's pattern. New words of
a batch are proposed tokens by greedy longest match, all at once; then every adjacent pair of proposed tokens is
tested: if no merge that ranks before the pieces' own merges crosses the border of any pair, the proposal is the
encoding. Only words that fail a test are merged exactly.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merloom.llm.ragged import spread

#: Where the public tokenizers lie; the file is read by the driver and broadcast (a vocabulary of fixed size, about 2 MB).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed values of the tokenizer: its word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct units a worker keeps before it starts anew, and characters of text it cuts at once.
UNITS, PIECE = 400_000, 1 << 21
#: Odd base of the hash by which tokens are looked up.
BASE = 0x9E3779B97F4A7C15


def load_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """The bytes of each token and the merges (left, right, token) in order of rank."""
    model = json.loads(Path(path).read_text())["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocab = model["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    for text, k in vocab.items():
        if all(c in byte for c in text):
            tokens[k] = bytes(byte[c] for c in text)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return tokens, np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)


class Encoder:
    """Encodes texts with a cache of units and words; one for each Python worker."""

    def __init__(self, tokens: list[bytes], merges: np.ndarray) -> None:
        size = len(tokens)
        self.single = np.zeros(256, np.int64)
        for k, t in enumerate(tokens):
            if len(t) == 1:
                self.single[t[0]] = k
        # rank of the merge that makes a token (0 for bytes), and its halves
        self.rank, self.left, self.right = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
        order = np.arange(1, len(merges) + 1)
        made, first = np.unique(merges[:, 2], return_index=True)
        self.rank[made], self.left[made], self.right[made] = order[first], merges[first, 0], merges[first, 1]
        pair = merges[:, 0] * size + merges[:, 1]
        by = np.argsort(pair)
        self.pair, self.pair_rank, self.pair_token = pair[by], order[by], merges[by, 2]
        self.merge_of = dict(zip(pair.tolist(), zip(order.tolist(), merges[:, 2].tolist(), strict=True), strict=True))
        self.size = size
        reachable = np.zeros(size, bool)
        reachable[made] = True
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(t) for t in tokens])
        for n in np.unique(lengths[reachable & (lengths > 1)]):
            ids = np.flatnonzero((lengths == n) & reachable)
            data = np.frombuffer(b"".join(tokens[k] for k in ids), np.uint8).reshape(-1, n)
            key = np.zeros(len(ids), np.uint64)
            for c in range(n):
                key = key * np.uint64(BASE) + data[:, c] + np.uint64(1)
            by = np.argsort(key)
            self.by_length[int(n)] = key[by], ids[by]
        self.cut = regex.compile(PATTERN).findall
        self.runs = regex.compile(r"\s*\S+|\s+").finditer
        self.spaced = regex.compile(r" \s").search
        self.failed = 0
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.heads, self.rest = _Fresh(), _Fresh()
        self.unit_flat, self.unit_start, self.unit_count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.known = 0

    # words ----------------------------------------------------------------------------------------------------------

    def _proposed(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match: tokens and the word of each."""
        token, length = self.single[data], np.ones(len(data), np.int64)
        room = np.repeat(end, end - begin) - np.arange(len(data))
        key, at = data.astype(np.uint64) + np.uint64(1), np.arange(len(data))
        have = 1
        for n, (keys, ids) in sorted(self.by_length.items()):
            while have < n:
                live = room[at] > have
                at, key = at[live], key[live]
                key = key * np.uint64(BASE) + data[at + have] + np.uint64(1)
                have += 1
            if not len(at):
                break
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[found] == key
            token[at[hit]], length[at[hit]] = ids[found[hit]], n
        taken = np.zeros(len(data), bool)
        here = begin
        while len(here):
            taken[here] = True
            step = here + length[here]
            on = step < np.repeat(end, end - begin)[here]
            here = step[on]
        where = np.flatnonzero(taken)
        return token[where], np.searchsorted(begin, where, "right") - 1

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b, side by side, ends in the same two tokens: no merge across the border comes before the merge that hides it."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            crossing = (self.pair[at] == key) & (self.pair_rank[at] < limit[live])
            ok[live[crossing]] = False
            live, x, y = live[~crossing], x[~crossing], y[~crossing]
            # undo the younger of the two tokens; before its merge the border lay between its inner half and the other
            undo_left = self.rank[x] > self.rank[y]
            bare = (self.rank[x] == 0) & (self.rank[y] == 0)
            live, x, y, undo_left = live[~bare], x[~bare], y[~bare], undo_left[~bare]
            # a merge on the left of equal rank comes first, one on the right later
            limit[live] = np.where(undo_left, self.rank[x], self.rank[y] + 1)
            a[live], b[live] = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return ok

    def merged(self, word: bytes) -> list[int]:
        """Exact merging of one word: the merge of lowest rank first, the leftmost of equals."""
        part: list[int] = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(m[0], k, part[k], part[k + 1]) for k in range(len(part) - 1) if (m := self.merge_of.get(part[k] * self.size + part[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, k, x, y = heapq.heappop(heap)
            j = after[k]
            if part[k] != x or j >= len(part) or part[j] != y:
                continue
            part[k], part[j] = self.merge_of[x * self.size + y][1], -1
            after[k] = after[j]
            if after[k] < len(part):
                before[after[k]] = k
            for i in (before[k], k):
                if i >= 0 and after[i] < len(part) and (m := self.merge_of.get(part[i] * self.size + part[after[i]])):
                    heapq.heappush(heap, (m[0], i, part[i], part[after[i]]))
        return [t for t in part if t >= 0]

    def _add_words(self, new: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        end = np.cumsum(size)
        token, word = self._proposed(data, end - size, end)
        border = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(token[border] * self.size + token[border + 1], return_inverse=True)
        good = self._compatible(pairs // self.size, pairs % self.size)[back]
        failing = np.unique(word[border[~good]])
        self.failed += len(failing)
        exact = {int(k): self.merged(raw[k]) for k in failing}
        keep = ~np.isin(word, failing)
        count = np.bincount(word[keep], minlength=len(new))
        flat = token[keep].astype(np.int32)
        if exact:
            more = np.fromiter(chain.from_iterable(exact.values()), np.int32)
            count[list(exact)] = [len(x) for x in exact.values()]
            which = np.concatenate([word[keep], np.repeat(list(exact), [len(x) for x in exact.values()])])
            flat = np.concatenate([flat, more])[np.argsort(which, kind="stable")]
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])

    # units and texts ------------------------------------------------------------------------------------------------

    def _add_units(self) -> None:
        new = [*self.heads.new, *(" " + u for u in self.rest.new)]
        order = np.array(self.heads.number + self.rest.number, np.int64)
        self.heads.clear_new()
        self.rest.clear_new()
        new = [new[k] for k in np.argsort(order)]
        cut = list(map(self.cut, new))
        flat = list(chain.from_iterable(cut))
        fresh = [w for w in dict.fromkeys(flat) if w not in self.words]
        if fresh:
            self.words.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh)), strict=True))
            self._add_words(fresh)
        word = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        tokens = self.flat[spread(self.start[word], self.count[word])]
        of_unit = np.repeat(np.arange(len(new)), [len(c) for c in cut])
        count = np.bincount(of_unit, self.count[word], len(new)).astype(np.int64)
        self.unit_start = np.concatenate([self.unit_start, len(self.unit_flat) + np.cumsum(count) - count])
        self.unit_flat, self.unit_count = np.concatenate([self.unit_flat, tokens]), np.concatenate([self.unit_count, count])

    def _unit_numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts, and how many each text has."""
        counts, parts = [], []
        heads, rest = self.heads, self.rest
        heads.owner = rest.owner = self
        for text in texts:
            if not text:
                counts.append(0)
            elif self.spaced(text) is None:
                first, *others = text.split(" ")
                # a text that begins with a space has an empty first unit
                parts.append(([heads[first]] if first else []) + list(map(rest.__getitem__, others)))
                counts.append(len(parts[-1]))
            else:
                found, n = self.runs(text), 0
                while block := [m.group() for m in islice(found, 1 << 18)]:
                    parts.append([rest[u[1:]] if u[0] == " " else heads[u] for u in block])
                    n += len(block)
                counts.append(n)
        return np.fromiter(chain.from_iterable(parts), np.int64, sum(counts)), np.array(counts, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit numbers, units of each text and tokens of each text."""
        if self.known > UNITS:
            self.forget()
        unit, counts = self._unit_numbers(texts)
        if self.heads.new or self.rest.new:
            self._add_units()
        ends = np.r_[0, np.cumsum(self.unit_count[unit])]
        edge = np.r_[0, np.cumsum(counts)]
        return unit, counts, ends[edge[1:]] - ends[edge[:-1]]

    def ids(self, unit: np.ndarray) -> np.ndarray:
        return self.unit_flat[spread(self.unit_start[unit], self.unit_count[unit])]


class _Fresh(dict):
    """Numbers of units; a new one gets the owner's next number and is noted."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.number: list[int] = []
        self.owner: Encoder

    def __missing__(self, unit: str) -> int:
        n = self.owner.known
        self.owner.known = n + 1
        self[unit] = n
        self.new.append(unit)
        self.number.append(n)
        return n

    def clear_new(self) -> None:
        self.new, self.number = [], []


_encoders: dict[int, Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """This worker's encoder for a broadcast vocabulary."""
    tokens, merges = shared.value
    key = hash((len(tokens), merges.tobytes()))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokens, merges)
    return _encoders[key]


def text_blocks(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of rows with about `most` bytes of text; null texts are empty."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    group = np.cumsum(size) // most
    edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(size)] if len(size) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def _encoded(batches: Iterator[pa.RecordBatch], shared, whole: bool) -> Iterator[pa.RecordBatch]:
    encoder = worker_encoder(shared)
    for batch in batches:
        for lo, hi, texts in text_blocks(batch.column(1)):
            unit, _, tokens = encoder.encode(texts)
            own = batch.column(0).slice(lo, hi - lo)
            if whole:
                ends = np.r_[0, np.cumsum(tokens)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(ends), pa.array(encoder.ids(unit)))], ["id", "ids"])
            else:
                yield pa.RecordBatch.from_arrays([own, pa.array(tokens)], ["id", "tokens"])


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id, ids (array of int): the tokens of each text, without special tokens.

    A null or empty text has an empty list. Every row is encoded, repeated ones again; a null id stays null. Texts of any
    length are taken whole. An empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    return _rows(df, id_col, text_col).mapInArrow(lambda it: _encoded(it, shared, True), "id bigint, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id, tokens: the number of tokens of each text, 0 for null and empty ones."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    return _rows(df, id_col, text_col).mapInArrow(lambda it: _encoded(it, shared, False), "id bigint, tokens bigint")


def _decoded(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    size, data = shared.value
    start = np.cumsum(size) - size
    for batch in batches:
        lists = batch.column(1).cast(pa.large_list(pa.int64())) if batch.column(1).type != pa.large_list(pa.int64()) else batch.column(1)
        ids, edge = lists.flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())]
        ends = np.r_[0, np.cumsum(size[ids])][edge].astype(np.int64)
        text = data[spread(start[ids], size[ids])]
        texts = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(ends.tobytes()), pa.py_buffer(text.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), texts.cast(pa.string())], ["id", "text"])


def texts_of(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """id, text: what lists of token ids stand for; null and empty lists give an empty text."""
    tokens, _ = load_vocabulary(vocabulary)
    shared = encoded.sparkSession.sparkContext.broadcast((np.array([len(t) for t in tokens], np.int64), np.frombuffer(b"".join(tokens), np.uint8)))
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<bigint>").alias("ids"))
    return rows.mapInArrow(lambda it: _decoded(it, shared), "id bigint, text string")
