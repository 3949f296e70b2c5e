"""Laying texts into containers of fixed capacity: bounded-space best fit.

Every partition keeps a fixed number of open containers for each request. An item goes where it leaves the least room;
when it fits nowhere, the fullest open container is closed and a new one opened. What is open at the end of a partition
is merged afterwards with what other partitions left.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merloom.llm.tokens import token_counts
from merloom.storage import written

#: Open containers of a request in a partition, and partitions whose leftovers are merged by one task.
OPEN, MERGED = 64, 64
_SCHEMA = "request_id int, container bigint, id bigint, piece_no int, piece_start bigint, tokens bigint, closed boolean"


class _Shelf:
    """The open containers of one request in one partition, in order of the room left."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next, self.open = capacity, first, []
        self.closed: set[int] = set()

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> int:
        k = bisect_left(self.open, (size, -1))
        if k < len(self.open):
            room, container = self.open.pop(k)
        else:
            if len(self.open) >= OPEN:
                self.closed.add(self.open.pop(0)[1])
            room, container = self.capacity, self.fresh()
        if room > size:
            insort(self.open, (room - size, container))
        else:
            self.closed.add(container)
        return container


def _packed(batches: Iterator[pa.RecordBatch], requests: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 36
    shelves = {r: _Shelf(c, first) for r, c in requests}
    schema = pa.schema([("request_id", pa.int32()), ("container", pa.int64()), ("id", pa.int64()), ("piece_no", pa.int32()), ("piece_start", pa.int64()), ("tokens", pa.int64()), ("closed", pa.bool_())])
    waiting: dict[tuple[int, int], list[tuple]] = {}
    for batch in batches:
        out: list[tuple] = []
        for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for request, shelf in shelves.items():
                full = (size - 1) // shelf.capacity if size else 0
                for n in range(full):
                    out.append((request, shelf.fresh(), key, n, n * shelf.capacity, shelf.capacity, True))
                rest = size - full * shelf.capacity
                c = shelf.place(rest)
                waiting.setdefault((request, c), []).append((request, c, key, full, full * shelf.capacity, rest))
                if shelf.closed:
                    out.extend((*row, True) for c in shelf.closed for row in waiting.pop((request, c)))
                    shelf.closed.clear()
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    rows = [(*row, False) for part in waiting.values() for row in part]
    for k in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows[k : k + 20_000], strict=True), schema, strict=True)], schema=schema)


def _merged(left: pd.DataFrame) -> pd.DataFrame:
    """Leftover containers of one request, largest first, each into the one it fills best; the number of open ones is not limited, but at most OPEN * MERGED come here."""
    left = left.sort_values(["used", "container"], ascending=[False, True])
    capacity, open_ = int(left["capacity"].iloc[0]), []
    target = []
    for used, container in zip(left["used"].tolist(), left["container"].tolist(), strict=True):
        k = bisect_left(open_, (used, -1))
        room, into = open_.pop(k) if k < len(open_) else (capacity, container)
        target.append(into)
        insort(open_, (room - used, into))
    return pd.DataFrame({"request_id": left["request_id"].to_numpy(), "container": left["container"].to_numpy(), "into": target})


def pack(items: DataFrame, requests: DataFrame, request_col: str = "request_id", amount_col: str = "amount") -> DataFrame:
    """request_id, container, id, piece_no, piece_start, tokens for items (id, tokens) and each request's capacity.

    Only an item longer than the capacity is split: into full containers and one last piece. An item of 0 tokens takes a
    place but no room. Requests with a null capacity or one below 1 are left out; repeated requests count once. No item
    gives no rows. Requests are few (their table is read by the driver: at most 10,000 rows, more raise an error).
    """
    wanted = requests.select(F.col(request_col).cast("int"), F.col(amount_col).cast("bigint")).where(F.col(amount_col) >= 1).dropna().distinct().limit(10_001).collect()
    if len(wanted) > 10_000:
        raise ValueError("more than 10,000 requests")
    sizes = sorted((r[0], r[1]) for r in wanted)
    placed = written(items.select("id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")).mapInArrow(lambda it: _packed(it, sizes), _SCHEMA), "packed")
    capacity = requests.select(F.col(request_col).cast("int").alias("request_id"), F.col(amount_col).cast("bigint").alias("capacity")).distinct()
    left = placed.where("not closed").groupBy("request_id", "container").agg(F.sum("tokens").alias("used")).join(F.broadcast(capacity.limit(10_000)), "request_id")
    left = left.withColumn("team", F.floor(F.shiftright("container", 36) / MERGED))
    moves = left.groupBy("request_id", "team").applyInPandas(_merged, "request_id int, container bigint, into bigint")
    last = placed.where("not closed").join(moves, ["request_id", "container"]).withColumn("container", F.col("into"))
    columns = ["request_id", "container", "id", "piece_no", "piece_start", "tokens"]
    return placed.where("closed").select(columns).unionByName(last.select(columns))


def containers(df: DataFrame, requests: DataFrame, id_col: str = "doc_id", text_col: str = "text", **where: str) -> DataFrame:
    """pack() for texts measured in tokens; null and empty texts have 0 tokens."""
    return pack(token_counts(df, id_col, text_col, **where), requests)


def packing_facts(placed: DataFrame, requests: DataFrame, request_col: str = "request_id", amount_col: str = "amount") -> DataFrame:
    """request_id, items, over, torn: of the rows of pack(), how many items each request has, how many containers hold more than the capacity, and how many items are split though they fit or are not whole and in order."""
    capacity = requests.select(F.col(request_col).cast("int").alias("request_id"), F.col(amount_col).cast("bigint").alias("capacity")).distinct()
    sums = placed.groupBy("request_id", "container").agg(F.sum("tokens").alias("used")).join(F.broadcast(capacity), "request_id")
    over = sums.groupBy("request_id").agg(F.count_if(F.col("used") > F.col("capacity")).alias("over"))
    pieces = placed.groupBy("request_id", "id").agg(F.count("*").alias("n"), F.max("piece_no").alias("last"), F.sum("tokens").alias("whole"), F.max(F.col("piece_start") + F.col("tokens")).alias("end"))
    pieces = pieces.join(F.broadcast(capacity), "request_id")
    torn = (F.col("last") != F.col("n") - 1) | (F.col("end") != F.col("whole")) | ((F.col("n") > 1) & (F.col("whole") <= F.col("capacity")))
    items = pieces.groupBy("request_id").agg(F.count("*").alias("items"), F.count_if(torn).alias("torn"))
    return items.join(over, "request_id").select("request_id", "items", "over", "torn")
