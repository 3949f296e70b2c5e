"""Near-duplicate records found through a Gray-order hierarchical index.

Every distinct text gets a fingerprint of 16 bits of each of 64 min-hashes. Sixteen masks choose 64 of its bits each (four
whole min-hashes): a bit pattern that texts share under a mask is an upper node of the index. Another mask chooses two
bits of every min-hash; by the Gray rank of these 128 bits the texts of a node are sorted. Over this order stands a tree
whose nodes hold up to 16 others each and the bits that all texts below them share. Two tree nodes are compared by these
bits, and whole groups are pruned once the differences accumulated on the way down exceed the radius. What is left is
checked exactly. Nodes of many texts are cut into blocks in Gray order; pairs of blocks are pruned by their shared bits
before any row is copied, and the blocks of a pair that is left are compared exactly as a whole in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merloom.functions.residues import residues
from merloom.llm.ragged import row_slices, rolling, spread, text_bytes
from merloom.operators.skew import HOT_PAIRS, HOT_ROWS, hot_keys, salted_join, spread_join
from merloom.storage import tasks_for, written

#: Min-hashes of a fingerprint, bits kept of each, and min-hashes that a mask chooses.
HASHES, KEPT, CHOSEN = 64, 16, 4
#: Nodes under one tree node.
FAN = 16
#: Fingerprints of one upper node that a task compares by itself; larger nodes are cut into blocks of BLOCK_ROWS.
NODE_ROWS, BLOCK_ROWS = 256, 1024
#: Pairs of fingerprints held at once.
CHUNK = 1 << 20
#: Texts that hold a window from which on it is counted by a matrix product when two blocks are compared.
DENSE = 24
#: Class names (8 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
_SIGN = np.uint64(1 << 63)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def window_codes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each window of `width` bytes that lies in one row, and the number of windows of each row."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    values = rolling(data.astype(np.uint64) + np.uint64(1), width, 257)
    return values[spread(offsets[:-1], counts)], counts


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits ^ (bits >> np.uint64(shift))
    return bits


Words = tuple[np.ndarray, np.ndarray]


def gray_ranks(high: np.ndarray, low: np.ndarray) -> Words:
    """gray_rank() of patterns of 128 bits: the rank's two halves."""
    rank = gray_rank(high)
    return rank, gray_rank(low) ^ (np.uint64(0) - (rank & np.uint64(1)))


def gray_bits(high: np.ndarray, low: np.ndarray) -> Words:
    """The patterns of 128 bits with these ranks."""
    return high ^ (high >> np.uint64(1)), low ^ (low >> np.uint64(1)) ^ ((high & np.uint64(1)) << np.uint64(63))


def fingerprints(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, Words]:
    """Of texts whose window codes begin at `starts`: the pattern under each mask (masks x texts, different for each mask), and the 128 bits that are sorted."""
    a, b = _multipliers()
    codes = _mixed((codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32))
    node = np.zeros((HASHES // CHOSEN, len(starts)), np.uint64)
    bits = np.zeros((2, len(starts)), np.uint64)
    for k in range(HASHES):
        least = _mixed(np.minimum.reduceat(codes * a[k] + b[k], starts)).astype(np.uint64)
        node[k // CHOSEN] |= (least & np.uint64((1 << KEPT) - 1)) << np.uint64(KEPT * (k % CHOSEN))
        bits[0] |= (least & np.uint64(1)) << np.uint64(k)
        bits[1] |= (least >> np.uint64(1) & np.uint64(1)) << np.uint64(k)
    salt = np.random.default_rng(31).integers(0, 1 << 63, len(node), dtype=np.uint64)[:, None]
    node = (node ^ salt) * np.uint64(0xD6E8FEB86659FD93)
    return node ^ (node >> np.uint64(32)), (bits[0], bits[1])


def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(node, rank, low, id) for each mask of each distinct text of a batch (columns id, proof, text)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        ids, proof = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        order = np.lexsort((proof, ids))
        first = np.zeros(len(ids), bool)
        first[order] = np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(proof[order]) != 0)][: len(ids)]
        for lo, hi in row_slices(offsets, 1 << 19):
            o = offsets[lo : hi + 1]
            codes, counts = window_codes(data[o[0] : o[-1]], o - o[0], width)
            codes, counts = codes[np.repeat(first[lo:hi], counts)], counts * first[lo:hi]
            at = np.flatnonzero(counts)
            if not len(at):
                continue
            node, bits = fingerprints(codes, (np.cumsum(counts) - counts)[at])
            rank, low = gray_ranks(*bits)
            columns = [node.ravel(), np.tile(rank ^ _SIGN, len(node)), np.tile(low ^ _SIGN, len(node))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(np.tile(ids[lo:hi][at], len(node)))], ["node", "rank", "low", "id"])


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) ^ _SIGN


def _tree(bits: Words, first: np.ndarray, size: np.ndarray) -> list[tuple]:
    """Levels over runs of fingerprints in Gray order, the lowest first, up to one root for each run: first child, number of children, the bits shared by all below, and which bits are shared."""
    ones, some, levels = bits, bits, []
    while not levels or (size > 1).any():
        groups = -(-size // FAN)
        start = spread(np.zeros(len(first), np.int64), groups) * FAN + np.repeat(first, groups)
        count = np.minimum(start + FAN, np.repeat(first + size, groups)) - start
        at, edge = spread(start, count), np.cumsum(count) - count
        ones, some = ([f.reduceat(w[at], edge) for w in ws] for f, ws in ((np.bitwise_and, ones), (np.bitwise_or, some)))
        levels.append((start, count, ones, [~(x ^ y) for x, y in zip(ones, some, strict=True)]))
        first, size = np.cumsum(groups) - groups, groups
    return levels


def _search(bits: Words, first: np.ndarray, size: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within `radius` in each run of fingerprints in Gray order, from the roots down by accumulated differences."""
    if not len(first):
        return
    levels = _tree(bits, first, size)
    root = np.arange(len(levels[-1][0]))
    zero = np.zeros(len(root), np.uint64)
    waiting = [(len(levels) - 1, root, root, np.zeros(len(root), np.int64), (zero, zero))]
    while waiting:
        level, i, j, before, done = waiting.pop()
        start, count, _, _ = levels[level]
        n = count[i] * count[j]
        below = np.cumsum(n)
        if below[-1] > CHUNK and len(i) > 1:
            cuts = np.r_[0, np.flatnonzero(np.diff(below // CHUNK)) + 1, len(i)]
            cuts = cuts if len(cuts) > 2 else np.array([0, len(i) // 2, len(i)])
            waiting += [(level, i[p:q], j[p:q], before[p:q], tuple(d[p:q] for d in done)) for p, q in zip(cuts[:-1], cuts[1:], strict=True) if q > p]
            continue
        place, wide = spread(np.zeros(len(i), np.int64), n), np.repeat(count[j], n)
        x, y = np.repeat(start[i], n) + place // wide, np.repeat(start[j], n) + place % wide
        right = x < y if not level else x <= y
        right |= np.repeat(i != j, n)
        x, y, parent = x[right], y[right], np.repeat(np.arange(len(i)), n)[right]
        before, done = before[parent], tuple(d[parent] for d in done)
        if not level:
            apart = before + sum(np.bitwise_count((w[x] ^ w[y]) & ~d).astype(np.int64) for w, d in zip(bits, done, strict=True))
            yield x[apart <= radius], y[apart <= radius]
            continue
        _, _, ones, shared = levels[level - 1]
        both = [s[x] & s[y] for s in shared]
        apart = before + sum(np.bitwise_count((w[x] ^ w[y]) & s & ~d).astype(np.int64) for w, s, d in zip(ones, both, done, strict=True))
        near = np.flatnonzero(apart <= radius)
        if len(near):
            waiting.append((level - 1, x[near], y[near], apart[near], tuple(b[near] for b in both)))


def _candidates(batches: Iterator[pa.RecordBatch], radius: int, node_rows: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    """From rows in order of (node, rank, low): pairs a < b of one node; rows of a node with more than node_rows come out as (a = id, node, block, rank, low)."""
    names = ["a", "b", "node", "block", "rank", "low"]
    held: list[np.ndarray] = [np.empty(0, np.int64)] * 4
    streak = 0  # rows of the held node that went out as blocks
    before: tuple | None = None

    def spill(node: np.ndarray, rank: np.ndarray, low: np.ndarray, ids: np.ndarray, streak: int) -> pa.RecordBatch:
        block = (np.arange(len(node), dtype=np.int64) + streak) // block_rows
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), *map(pa.array, (node, block, rank, low))], names)

    def done(node: np.ndarray, rank: np.ndarray, low: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.diff(node)) + 1
        edges = np.r_[0, cut, len(node)]
        first, size = edges[:-1], np.diff(edges)
        keep = (size > 1) & (size <= node_rows)
        for x, y in _search(gray_bits(_unsigned(rank), _unsigned(low)), first[keep].astype(np.int64), size[keep], radius):
            x, y = ids[x], ids[y]
            null = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), null, null, null, null], names)
        for k in np.flatnonzero(size > node_rows):
            at = slice(edges[k], edges[k + 1])
            yield spill(node[at], rank[at], low[at], ids[at], 0)

    for batch in batches:
        new = [batch.column(k).to_numpy() for k in range(4)]
        if not len(new[0]):
            continue
        again = np.r_[before == tuple(x[0] for x in new), np.all([x[1:] == x[:-1] for x in new], axis=0)]
        before = tuple(x[-1] for x in new)
        new = [x[~again] for x in new]
        if not len(new[0]):
            continue
        if streak:
            same = int(np.argmax(np.r_[new[0] != held[0][0], True]))
            if same:
                yield spill(*(x[:same] for x in new), streak)
                streak += same
            if same == len(new[0]):
                continue
            new, streak, held = [x[same:] for x in new], 0, [np.empty(0, np.int64)] * 4
        node, rank, low, ids = (np.concatenate(x) for x in zip(held, new, strict=True))
        last = len(node) - int(np.argmax(node[::-1] != node[-1])) if node[0] != node[-1] else 0
        if last:
            yield from done(node[:last], rank[:last], low[:last], ids[:last])
        held = [node[last:], rank[last:], low[last:], ids[last:]]
        if len(held[0]) > node_rows:
            yield spill(*held, 0)
            streak, held = len(held[0]), [x[:1] for x in held]
    if len(held[0]) and not streak:
        yield from done(*held)


def _sorted_set(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _named(codes: np.ndarray, width: int) -> np.ndarray:
    """Windows of up to 5 residues have numbers below 2**48, longer ones 48 bits of a hash."""
    return codes if width <= 5 else codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)


_LINK = ["a", "proof_a", "b", "proof_b", "similarity"]


def _checked(batches: Iterator[pa.RecordBatch], width: int, share: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, proof_a, b, proof_b, text_a, text_b) whose sets of windows are similar."""
    for batch in batches:
        sides = []
        for column in (4, 5):
            codes, counts = window_codes(*text_bytes(batch.column(column)), width)
            sides.append((_named(codes, width), np.repeat(np.arange(len(counts), dtype=np.uint64), counts)))
        for lo in range(0, batch.num_rows, 1 << 11):
            hi = min(lo + (1 << 11), batch.num_rows)
            own = []
            for codes, row in sides:
                p, q = np.searchsorted(row, np.array([lo, hi], np.uint64))
                own.append(_sorted_set(codes[p:q] | (row[p:q] - np.uint64(lo)) << np.uint64(48)))
            both = np.concatenate(own)
            both.sort(kind="stable")
            same = both[1:][both[1:] == both[:-1]] >> np.uint64(48)
            common = np.bincount(same.astype(np.int64), minlength=hi - lo)
            union = sum(np.bincount((x >> np.uint64(48)).astype(np.int64), minlength=hi - lo) for x in own) - common
            ok = common >= share * union - 1e-9
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(4)), pa.array(common / np.maximum(union, 1))], _LINK).filter(pa.array(ok))


def common_windows(codes: np.ndarray, row: np.ndarray, rows: int, left: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows 0 to left - 1 against the others (all against all if there are none): a matrix of the numbers of windows in common, and the number of each row.

    Windows that many rows hold are counted by matrix products, the others by the pairs of rows that hold them.
    """
    code, row = _sorted_pairs(codes, row)
    size = np.bincount(row, minlength=rows)
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    held = np.diff(np.r_[start, len(code)])
    alone = left == rows
    right = rows if alone else rows - left
    common = np.zeros((left, right), np.float32)
    often = np.flatnonzero(held >= DENSE)
    for k in range(0, len(often), 4096):
        part = often[k : k + 4096]
        where = spread(start[part], held[part])
        m = np.zeros((rows, len(part)), np.float32)
        m[row[where], np.repeat(np.arange(len(part)), held[part])] = 1
        common += m[:left] @ (m if alone else m[left:]).T
    few = np.flatnonzero((held > 1) & (held < DENSE))
    step = CHUNK // DENSE**2
    for k in range(0, len(few), step):
        part = few[k : k + step]
        n = held[part] ** 2
        place, wide = spread(np.zeros(len(part), np.int64), n), np.repeat(held[part], n)
        x, y = row[np.repeat(start[part], n) + place // wide], row[np.repeat(start[part], n) + place % wide]
        ok = x < left if alone else (x < left) & (y >= left)
        np.add.at(common, (x[ok], y[ok] if alone else y[ok] - left), 1)
    return common, size


def _sorted_pairs(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((row, codes))
    codes, row = codes[order], row[order]
    new = np.r_[True, (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])][: len(codes)]
    return codes[new], row[new]


def _block_links(t: pa.Table, width: int, share: float) -> Iterator[pa.RecordBatch]:
    """Links between the two blocks of a pair (rows of side 0 and 1) or within one (side 0 only); each pair under the first mask that it shares."""
    t = t.combine_chunks()
    left, ids, proof = int((t.column("side").to_numpy() == 0).sum()), t.column("id").to_numpy(), t.column("proof").to_numpy()
    codes, counts = window_codes(*text_bytes(t.column("text").chunk(0) if t.column("text").num_chunks else pa.array([], pa.string())), width)
    node, _ = fingerprints(codes, np.cumsum(counts) - counts)
    common, size = common_windows(_named(codes, width), np.repeat(np.arange(len(counts)), counts), len(counts), left)
    alone = left == len(counts)
    other = 0 if alone else left
    own = int(np.flatnonzero(node[:, 0].view(np.int64) == t.column("node")[0].as_py())[0])
    for lo in range(0, left, 256):
        part = common[lo : lo + 256]
        x, y = np.nonzero(part >= share * (size[lo : lo + len(part), None] + size[None, other:] - part) - 1e-4)
        n = part[x, y].astype(np.int64)
        x, y = x + lo, y + other
        ok = (x < y) & (n >= share * (size[x] + size[y] - n) - 1e-9)
        for k in range(own):
            ok &= node[k][x] != node[k][y]
        x, y, n = x[ok], y[ok], n[ok]
        swap = (ids[x] > ids[y]) | (ids[x] == ids[y]) & (proof[x] > proof[y])
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        yield pa.RecordBatch.from_arrays([*map(pa.array, (ids[x], proof[x], ids[y], proof[y], n / np.maximum(size[x] + size[y] - n, 1)))], _LINK)


def _block_pairs(batches: Iterator[pa.RecordBatch], width: int, share: float) -> Iterator[pa.RecordBatch]:
    """From rows in order of (node, own, other, side): the links of each pair of blocks."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        keys = [t.column(c).to_numpy() for c in ("node", "own", "other")]
        cut = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1 if t.num_rows else np.empty(0, np.int64)
        edges = np.r_[0, cut]
        for k in range(len(cut)):
            yield from _block_links(t.slice(edges[k], edges[k + 1] - edges[k]), width, share)
        held = t.slice(edges[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield from _block_links(held, width, share)


def close_blocks(large: DataFrame, radius: int) -> DataFrame:
    """node, own, other of the pairs of blocks (and of each block with itself) whose shared bits leave room for a pair within the radius. `large` has a row for each text: node, block, rank, low, id."""
    sign = F.lit(-(1 << 63))
    high, low = F.col("rank").bitwiseXOR(sign), F.col("low").bitwiseXOR(sign)
    bits = {
        "x": high.bitwiseXOR(F.shiftrightunsigned(high, 1)),
        "y": low.bitwiseXOR(F.shiftrightunsigned(low, 1)).bitwiseXOR(F.shiftleft(high.bitwiseAND(F.lit(1)), 63)),
    }
    facts = [f(c).alias(f"{n}{k}") for k, c in bits.items() for n, f in (("all_", F.bit_and), ("any_", F.bit_or))]
    blocks = written(large.groupBy("node", "block").agg(*facts), "blocks")
    a, b = (blocks.select("node", F.col("block").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in blocks.columns[2:])) for end in ("own", "other"))

    def apart(k: str) -> Column:
        mixed = F.col(f"own_all_{k}").bitwiseXOR(F.col(f"own_any_{k}")).bitwiseOR(F.col(f"other_all_{k}").bitwiseXOR(F.col(f"other_any_{k}")))
        return F.bit_count(F.col(f"own_all_{k}").bitwiseXOR(F.col(f"other_all_{k}")).bitwiseAND(F.bitwise_not(mixed)))

    return a.join(b, "node").where((F.col("own") <= F.col("other")) & (apart("x") + apart("y") <= radius)).select("node", "own", "other")


def candidate_pairs(texts: DataFrame, width: int, radius: int, node_rows: int = NODE_ROWS, block_rows: int = BLOCK_ROWS, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of texts (id, proof, text; equal rows are copies): pairs a < b of ids that may be similar, each once; and the rows (node, block, rank, low, id) of nodes with more than `node_rows` texts."""
    signed = texts.select("id", "proof", "text").mapInArrow(lambda it: _signatures(it, width), "node bigint, rank bigint, low bigint, id bigint")
    ordered = (signed.repartition(tasks, "node") if tasks else signed.repartition("node")).sortWithinPartitions("node", "rank", "low", "id")
    found = written(ordered.mapInArrow(lambda it: _candidates(it, radius, node_rows, block_rows), "a bigint, b bigint, node bigint, block bigint, rank bigint, low bigint"), "nodes")
    return found.where("node is null").select("a", "b").distinct(), found.where("node is not null").select("node", "block", "rank", "low", F.col("a").alias("id"))


def _key(text: str = "text") -> tuple[Column, Column]:
    """A text's name of 128 bits as two numbers, hashes with two seeds; the first is its id in the index."""
    return F.xxhash64(text).alias("id"), F.xxhash64(F.lit(271_828), text).alias("proof")


def near_duplicates(df: DataFrame, id_col: str = "ord", seq_col: str = "seq", width: int = 5, share: float = 0.7, least: int = 20, radius: int = 36, node_rows: int = NODE_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Similar texts: links (class_a, class_b, similarity) between classes of equal residues, and the members (class, id) of every class; both as written tables.

    Two texts are similar if their sets of `width`-residue windows have a Jaccard similarity of at least `share`.
    Rows with a null id, null text or fewer than `least` residues are in no class. Repeated rows with one id stand once.
    An empty table gives no rows. Texts of any length are taken whole. A class is named by the 128-bit hash of its
    residues. Copies are dropped within each batch and again in each node, so a class that holds a third of all rows
    costs one row a batch. The index goes by 64 bits of the name; texts that agree in these are told apart when checked.
    """
    rows_in = df.select(F.col(id_col).cast("bigint").alias("row"), residues(F.col(seq_col)).alias("text")).where(F.col("row").isNotNull() & (F.length("text") >= max(least, width)))
    texts = rows_in.select(*_key(), "text")
    tasks = tasks_for(df)
    pairs, large = candidate_pairs(texts, width, radius, node_rows, block_rows, tasks)
    pairs = written(pairs, "pairs")
    hot = not large.isEmpty()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    wanted = written((ids.unionByName(large.select("id")) if hot else ids).groupBy("id").agg(F.count("*").alias("pairs")), "wanted")
    needed = texts.join(F.broadcast(wanted.select("id")) if wanted.count() <= BROADCAST_ROWS else wanted.select("id"), "id", "left_semi")
    needed = needed.groupBy("id").agg(F.collect_set(F.struct("proof", "text")).alias("t")).select("id", F.explode("t").alias("t")).select("id", "t.proof", "t.text")
    both, often = pairs, hot_keys(wanted, "id", "pairs", HOT_ROWS)
    for x in "ab":
        side = needed.select(F.col("id").alias(x), F.col("proof").alias(f"proof_{x}"), F.col("text").alias(f"text_{x}"))
        both = spread_join(both, side, x, often)
    both = both.select("a", "proof_a", "b", "proof_b", "text_a", "text_b")
    link = "a bigint, proof_a bigint, b bigint, proof_b bigint, similarity double"
    links = both.mapInArrow(lambda it: _checked(it, width, share), link)
    if hot:
        close = written(close_blocks(large, radius), "close")
        rows = spread_join(large.select("node", "block", "id"), needed, "id", often).select("node", "block", "id", "proof", "text")
        own = rows.join(close.withColumnRenamed("own", "block"), ["node", "block"]).select("node", F.col("block").alias("own"), "other", F.lit(0).alias("side"), "id", "proof", "text")
        far = rows.join(close.where("own < other").withColumnRenamed("other", "block"), ["node", "block"]).select("node", "own", F.col("block").alias("other"), F.lit(1).alias("side"), "id", "proof", "text")
        blocks = own.unionByName(far).repartition(tasks, "node", "own", "other").sortWithinPartitions("node", "own", "other", "side", "id")
        links = links.unionByName(blocks.mapInArrow(lambda it: _block_pairs(it, width, share), link)).distinct()
    links = links.select(F.struct(F.col("a").alias("id"), F.col("proof_a").alias("proof")).alias("class_a"), F.struct(F.col("b").alias("id"), F.col("proof_b").alias("proof")).alias("class_b"), "similarity")
    members = rows_in.select(F.struct(*_key()).alias("class"), F.col("row").alias("id")).distinct()
    return written(links, "links"), written(members, "members")


def similar_rows(links: DataFrame, members: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Every pair id_a < id_b of rows in one class or in two linked classes. Its size is that of the answer: a class of n copies has n(n-1)/2 pairs, made in as many tasks as they need."""
    ways = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("ways"))
    sizes = written(members.groupBy("class").agg(F.count("*").alias("n")).join(ways, "class", "left").select("class", "n", (F.col("n") * (F.col("n") + F.coalesce("ways", F.lit(0)))).alias("made")).where("n > 1"), "sizes")
    hot = hot_keys(sizes, "class", "made", hot_pairs)
    a, b = members.select(F.col("class").alias("class_a"), F.col("id").alias("x")), members.select(F.col("class").alias("class_b"), F.col("id").alias("y"))
    across = spread_join(spread_join(links.select("class_a", "class_b"), a, "class_a", hot).select("class_b", "x"), b, "class_b", hot).select("x", "y")
    copies = members.join(sizes.select("class"), "class", "left_semi")
    within = spread_join(copies.withColumnRenamed("id", "x"), copies.withColumnRenamed("id", "y"), "class", hot).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def class_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """id_a < id_b, similarity: each link between different texts once, by the smallest ids of their classes."""
    first = members.groupBy("class").agg(F.min("id").alias("first"))
    named = links.join(first.select(F.col("class").alias("class_a"), F.col("first").alias("x")), "class_a").join(first.select(F.col("class").alias("class_b"), F.col("first").alias("y")), "class_b")
    return named.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def class_members(links: DataFrame, members: DataFrame) -> DataFrame:
    """id, first, copies, links of each row in a class: the smallest id of its class, the rows of the class, and the number of other rows that are similar to it."""
    sizes = members.groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    ways = links.select(F.col("class_a").alias("class"), F.col("class_b").alias("to")).unionByName(links.select(F.col("class_b").alias("class"), F.col("class_a").alias("to")))
    near = ways.join(sizes.select(F.col("class").alias("to"), "copies"), "to").groupBy("class").agg(F.sum("copies").alias("near"))
    facts = sizes.join(near, "class", "left").select("class", "first", "copies", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return salted_join(members, facts, "class", "copies").select("id", "first", "copies", "links")
