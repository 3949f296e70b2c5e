"""Long spans that stand verbatim in more than one record.

Every window of `span` residues has a Rabin-Karp hash. Windows are brought together by the smallest hashed mer in them
(equal windows have equal smallest mers), as runs of neighbouring windows packed in one binary column for each batch
and bucket, so that a window costs about four bytes in the shuffle instead of a row. Windows that several records
of a batch hold are combined there: they are reported at once and go on for two records, so that other batches learn of it.
A mer that a large part of these windows has as its smallest is passed over for the next one (windows that hold no other
mer go by their own hash), so no mer fills a bucket; a bucket that is still large is counted in several turns by hash, so
that its memory is bounded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merloom.functions.residues import residues
from merloom.llm.ragged import rolling, spread, text_bytes
from merloom.storage import bytes_of, forget, tasks_for, written

#: Odd bases of the two Rabin-Karp hashes modulo 2**64, and of the mers.
BASE, PROOF, MER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Residues hashed at once.
PIECE = 1 << 19
#: Windows of a bucket that are counted at once.
HELD = 1 << 20
#: Least share of the sampled windows from which on a mer is hot (half of a task's share, if that is more), windows that it has there at least, and bytes of the table that the sample stands for. The sample only settles where windows meet, not what comes out.
HOT_SHARE, HOT_LEAST, SAMPLE_BYTES = 1 / 2000, 200, 4 << 20


def _letters(data: np.ndarray) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)[data]


def _pieces(offsets: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of about PIECE residues as (row, start within the row, length); long rows come in parts that overlap by span - 1."""
    step = PIECE - span + 1
    length = np.diff(offsets)
    parts = np.maximum(-(-(length - span + 1) // step), 0)
    row = np.repeat(np.arange(len(length)), parts)
    start = spread(np.zeros(len(length), np.int64), parts) * step
    size = np.minimum(length[row] - start, PIECE)
    group = np.cumsum(size) // PIECE
    for k in np.split(np.arange(len(row)), np.flatnonzero(np.diff(group)) + 1) if len(row) else []:
        yield row[k], start[k], size[k]


def _runs(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of neighbouring places of one owner."""
    if not len(owner):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)])
    return first, np.diff(np.r_[first, len(owner)])


def _hashes(data: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The two Rabin-Karp hashes of the windows at `at`."""
    tab = _letters(data)
    return rolling(tab, span, BASE)[at], rolling(tab, span, PROOF)[at]


def _repeats(key: np.ndarray, proof: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows stand in more than one owner, and which to keep: all of a text with one owner, else one of its smallest and one of its largest owner."""
    order = np.argsort(key, kind="stable")
    key, proof, who = key[order], proof[order], owner[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (proof[1:] != proof[:-1])]
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    low, high = np.minimum.reduceat(who, start), np.maximum.reduceat(who, start)
    many = (low != high)[group]
    shared, keep = np.zeros(len(who), bool), np.zeros(len(who), bool)
    shared[order], keep[order] = many, ~many
    for end in (low, high):
        found = np.flatnonzero(many & (who == end[group]))
        keep[order[found[np.r_[True, group[found[1:]] != group[found[:-1]]][: len(found)]]]] = True
    return shared, keep


#: Stands for the smallest mer of a window all of whose mers are hot.
NONE = (1 << 44) - 1


def _smallest_mers(data: np.ndarray, span: int, mer: int, hot: np.ndarray) -> np.ndarray:
    """For each window of `span` bytes 44 bits of the smallest hash of a mer in it that is not hot, and 20 bits of that mer's place; the first of equal ones."""
    low = rolling(_letters(data), mer, MER)
    low = low ^ (low >> np.uint64(29))
    low = (low * np.uint64(0xBF58476D1CE4E5B9)) & np.uint64(~((1 << 20) - 1) & (1 << 64) - 1) | np.arange(len(low), dtype=np.uint64)
    if len(hot):
        low |= np.where(np.isin(low >> np.uint64(20), hot), np.uint64(NONE << 20), np.uint64(0))
    have, reach = 1, span - mer + 1
    while have < reach:
        step = min(have, reach - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def _mer_counts(batches: Iterator[pa.RecordBatch], span: int, mer: int) -> Iterator[pa.RecordBatch]:
    """(mer, windows): how many windows of the batch (columns id, text) go on under which smallest mer."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        ids = batch.column(0).to_numpy()
        for row, start, size in _pieces(offsets, span):
            letters, counts = data[spread(offsets[row] + start, size)], size - span + 1
            at = spread(np.cumsum(size) - size, counts)
            _, keep = _repeats(*_hashes(letters, at, span), np.repeat(ids[row], counts))
            mers, n = np.unique(_smallest_mers(letters, span, mer, np.empty(0, np.uint64))[at][keep] >> np.uint64(20), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(mers.view(np.int64)), pa.array(n)], ["mer", "windows"])


def hot_mers(rows: DataFrame, part: int, share: float, span: int, mer: int) -> list[int]:
    """The smallest mers of at least `share` (and HOT_LEAST) of the windows that go on, in every part-th row (id, text) by hash of the id; at most 1 / share."""
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(part)) == 0)
    counts = written(some.mapInArrow(lambda it: _mer_counts(it, span, mer), "mer bigint, windows bigint").groupBy("mer").agg(F.sum("windows").alias("n")), "mers")
    total = counts.agg(F.sum("n")).scalar()
    hot = [r["mer"] for r in counts.where((F.col("n") >= HOT_LEAST) & (F.col("n") >= share * total)).select("mer").collect()]
    forget(counts)
    return hot


def _packed(letters: np.ndarray) -> np.ndarray:
    """Three letters in two bytes; the length is a multiple of three."""
    x = (letters.astype(np.uint16) - 65).reshape(-1, 3)
    return (x[:, 0] * np.uint16(676) + x[:, 1] * np.uint16(26) + x[:, 2]).astype(np.uint16)


def _unpacked(x: np.ndarray) -> np.ndarray:
    return (np.stack([x // 676, x // 26 % 26, x % 26], 1).ravel() + 65).astype(np.uint8)


def _gathered(data: np.ndarray, first: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The texts data[first : first + letters], each filled up to a multiple of three."""
    full = -(-letters // 3) * 3
    at = spread(first, full)
    return data[np.minimum(at, len(data) - 1)]


def _spread_windows(batches: Iterator[pa.RecordBatch], span: int, mer: int, buckets: int, hot: list[int]) -> Iterator[pa.RecordBatch]:
    """(bucket, payload) rows for windows that go on, and (id, first, windows) rows for runs of windows shared within the batch."""
    names = ["bucket", "payload", "id", "first", "windows"]
    hot_ones = np.sort(np.array(hot, np.int64)).view(np.uint64)
    for batch in batches:
        all_data, offsets = text_bytes(batch.column(1))
        ids = batch.column(0).to_numpy()
        for row, start, size in _pieces(offsets, span):
            data = all_data[spread(offsets[row] + start, size)]
            counts = size - span + 1
            begin = np.cumsum(size) - size
            at = spread(begin, counts)
            owner, place = np.repeat(ids[row], counts), spread(start, counts)
            key, proof = _hashes(data, at, span)
            shared, keep = _repeats(key, proof, owner)
            first, length = _runs(owner[shared], place[shared])
            null = pa.nulls(len(first), pa.int32()), pa.nulls(len(first), pa.binary())
            yield pa.RecordBatch.from_arrays([*null, pa.array(owner[shared][first]), pa.array(place[shared][first]), pa.array(length)], names)
            low = _smallest_mers(data, span, mer, hot_ones)[at][keep]
            at, owner, place, key = at[keep], owner[keep], place[keep], key[keep]
            if not len(at):
                continue
            alone = low >> np.uint64(20) == np.uint64(NONE)
            cut = np.r_[True, (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1) | alone[1:]]
            first = np.flatnonzero(cut)
            windows = np.diff(np.r_[first, len(at)])
            name = np.where(alone[first], key[first] ^ key[first] >> np.uint64(31), low[first] >> np.uint64(20))
            bucket = (name * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            first, windows, bucket = first[order], windows[order], bucket[order]
            letters = windows + span - 1
            text = _packed(_gathered(data, at[first], letters))
            edge = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
            text_end = np.r_[0, np.cumsum(-(-letters // 3))]
            out, who, where, wide = [], owner[first], place[first], windows.astype(np.uint8)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                base = int(who[a:b].min())
                near = int(who[a:b].max()) - base < 1 << 32
                short = int(where[a:b].max()) < 1 << 16
                head = struct.pack("<qqq??", b - a, base, text_end[b] - text_end[a], near, short)
                out.append(b"".join([head, (who[a:b] - base).astype(np.uint32 if near else np.uint64).tobytes(), where[a:b].astype(np.uint16 if short else np.uint32).tobytes(), wide[a:b].tobytes(), text[text_end[a] : text_end[b]].tobytes()]))
            null = [pa.nulls(len(out), pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array(out, pa.binary()), *null], names)


def _read(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, base, texts, near, short = struct.unpack_from("<qqq??", payload)
    at = struct.calcsize("<qqq??")
    who = np.frombuffer(payload, np.uint32 if near else np.uint64, n, at).astype(np.int64) + base
    at += n * (4 if near else 8)
    where = np.frombuffer(payload, np.uint16 if short else np.uint32, n, at).astype(np.int64)
    at += n * (2 if short else 4)
    windows = np.frombuffer(payload, np.uint8, n, at).astype(np.int64)
    return who, where, windows, np.frombuffer(payload, np.uint16, texts, at + n)


def _groups(payloads: list[bytes], most: int) -> list[list[bytes]]:
    """The payloads in groups of about `most` windows."""
    n = np.cumsum([int(_read(x)[2].sum()) for x in payloads])
    return [[payloads[i] for i in k] for k in np.split(np.arange(len(payloads)), np.flatnonzero(np.diff(n // most)) + 1)]


def _windows_of(groups: list[list[bytes]], span: int, turn: int) -> tuple[np.ndarray, ...]:
    """key, proof, owner and place of the windows whose hash falls into this turn; there are as many turns as groups."""
    out = []
    for group in groups:
        who, where, windows, text = (np.concatenate(x) for x in zip(*map(_read, group), strict=True))
        full = -(-(windows + span - 1) // 3) * 3
        found = (*_hashes(_unpacked(text), spread(np.cumsum(full) - full, windows), span), np.repeat(who, windows), spread(where, windows))
        mine = slice(None) if len(groups) == 1 else (found[0] >> np.uint64(7)) % np.uint64(len(groups)) == np.uint64(turn)
        out.append([x[mine] for x in found])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _shared_runs(batches: Iterator[pa.RecordBatch], span: int, most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket: counts the windows of each bucket by hash, in turns of about `most`, and gives the runs of those in more than one record; runs already found pass."""
    held: list[bytes] = []
    bucket = -1

    def done() -> Iterator[pa.RecordBatch]:
        groups = _groups(held, most)
        for turn in range(len(groups)):
            key, proof, owner, place = _windows_of(groups, span, turn)
            if not len(key):
                continue
            shared, _ = _repeats(key, proof, owner)
            owner, place = owner[shared], place[shared]
            first, length = _runs(owner, place)
            yield pa.RecordBatch.from_arrays([pa.array(owner[first]), pa.array(place[first]), pa.array(length)], ["id", "first", "windows"])

    for batch in batches:
        ready = batch.filter(batch.column(0).is_null())
        if ready.num_rows:
            yield ready.select(["id", "first", "windows"])
        for b, payload in zip(batch.column(0), batch.column(1), strict=True):
            if (b := b.as_py()) is None:
                continue
            if b != bucket and held:
                yield from done()
                held = []
            bucket = b
            held.append(payload.as_py())
    if held:
        yield from done()


def shared_windows(df: DataFrame, id_col: str = "ord", seq_col: str = "seq", span: int = 25, mer: int = 9, buckets_a_task: int = 8, most: int = HELD) -> DataFrame:
    """id, first, windows: runs of windows of a record that also stand in a record with another id (runs may overlap or touch)."""
    if not 1 <= mer <= span <= 255:
        raise ValueError("need 1 <= mer <= span <= 255")
    tasks = tasks_for(df)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), residues(F.col(seq_col)).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= span))
    hot = hot_mers(rows, max(1, round((bytes_of(df) or 0) / SAMPLE_BYTES)), max(HOT_SHARE, 1 / (2 * tasks)), span, mer)
    sent = rows.mapInArrow(lambda it: _spread_windows(it, span, mer, tasks * buckets_a_task, hot), "bucket int, payload binary, id bigint, first bigint, windows bigint")
    spread_out = sent.repartition(tasks, F.coalesce("bucket", F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int"))).sortWithinPartitions("bucket")
    return spread_out.mapInArrow(lambda it: _shared_runs(it, span, most), "id bigint, first bigint, windows bigint")


def shared_spans(df: DataFrame, id_col: str = "ord", seq_col: str = "seq", span: int = 25, mer: int = 9) -> DataFrame:
    """id, span_start (from 1), span_len: the maximal runs of residues covered by windows of `span` residues that also stand in a record with another id.

    Rows with a null id or fewer than `span` residues share nothing, and a row delivered twice under one id shares
    nothing with itself. Long texts are hashed in overlapping parts, whole. An empty table gives no rows.
    """
    runs = shared_windows(df, id_col, seq_col, span, mer)
    order = Window.partitionBy("id").orderBy("first", "windows")
    until = F.max(F.col("first") + F.col("windows") + span - 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = runs.withColumn("fresh", F.when(F.coalesce(F.col("first") > until, F.lit(True)), 1).otherwise(0))
    part = fresh.withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = part.groupBy("id", "part").agg(F.min("first").alias("a"), F.max(F.col("first") + F.col("windows") + span - 1).alias("b"))
    return spans.select("id", (F.col("a") + 1).alias("span_start"), (F.col("b") - F.col("a")).alias("span_len"))


def shared_parts(df: DataFrame, id_col: str = "ord", seq_col: str = "seq", span: int = 25) -> DataFrame:
    """id, residues, shared, share: for each record with a residue, how much of it stands in shared spans."""
    whole = df.select(F.col(id_col).cast("bigint").alias("id"), F.length(residues(F.col(seq_col))).cast("bigint").alias("residues")).where("id is not null and residues > 0").groupBy("id").agg(F.max("residues").alias("residues"))
    part = shared_spans(df, id_col, seq_col, span).groupBy("id").agg(F.sum("span_len").alias("shared"))
    shared = F.coalesce("shared", F.lit(0)).cast("bigint")
    return whole.join(part, "id", "left").select("id", "residues", shared.alias("shared"), (shared / F.col("residues")).alias("share"))
