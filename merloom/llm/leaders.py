"""The most frequent values of a column, by the three-phase threshold method."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merloom.storage import written

#: Candidates that are broadcast at most; more are joined by a shuffle.
CANDIDATES = 100_000


def _local(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The sums of one node, by value. A node that meets more than `most` values sends what it has and goes on as another node."""
    from pyspark import TaskContext

    node, held = TaskContext.get().partitionId() << 24, None

    def sums(t: pa.Table) -> pa.Table:
        return t.group_by("value").aggregate([("n", "sum")]).select(["value", "n_sum"]).rename_columns(["value", "n"])

    waiting: list[pa.Table] = []
    rows = 0
    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        # summed when as much waits as is held, so that no row is summed again and again
        if rows >= max(100_000, held.num_rows if held is not None else 0):
            held, waiting, rows = sums(pa.concat_tables([*([held] if held is not None else []), *waiting])), [], 0
            if held.num_rows > most:
                yield from held.append_column("node", pa.array([node] * held.num_rows, pa.int64())).to_batches()
                node, held = node + 1, None
    if waiting:
        held = sums(pa.concat_tables([*([held] if held is not None else []), *waiting]))
    if held is not None:
        yield from held.append_column("node", pa.array([node] * held.num_rows, pa.int64())).combine_chunks().to_batches()


def local_sums(df: DataFrame, value_col: str, count_col: str | None = None, most: int = 1_000_000) -> DataFrame:
    """value, n, node: every node's sums, as a written table. Rows with a null value or count are left out; counts below 0 are an error."""
    n = F.lit(1).cast("bigint") if count_col is None else F.col(count_col).cast("bigint")
    n = F.when(n < 0, F.raise_error("a count is below 0").cast("bigint")).otherwise(n)
    rows = df.select(F.upper(F.col(value_col)).alias("value"), n.alias("n")).where("value is not null and n is not null")
    return written(rows.mapInArrow(lambda it: _local(it, most), "value string, n bigint, node bigint"), "local")


def heavy_values(df: DataFrame, value_col: str = "mer", count_col: str | None = "cnt", share: float | None = None, k: int | None = None, most: int = 1_000_000, broadcast_rows: int = CANDIDATES) -> DataFrame:
    """value, total: all values with at least `share` of the sum of all counts, or the `k` values with the largest totals (ties by value).

    Case is ignored (values come out in upper case). Phase one: every node sums its rows and sends its k leaders; the
    k-th largest sum of these is a lower bound (with `share` the bound is that share of the sum). Phase two: every node
    sends the values above its share of the bound; only these can reach it. Phase three: their totals are fetched from
    all nodes and compared exactly. An empty table gives no rows. Candidates are counted: up to `broadcast_rows` of them
    are broadcast, more are joined by a shuffle, in which a value has no more rows than there are nodes. A node holds at
    most about `most` values.
    """
    if (share is None) == (k is None):
        raise ValueError("give either share or k")
    local = local_sums(df, value_col, count_col, most)
    facts = local.agg(F.sum("n").alias("all"), F.count_distinct("node").alias("nodes")).first()
    if not facts["nodes"] or not facts["all"]:
        return local.select("value", F.col("n").alias("total")).limit(0)
    if share is not None:
        bound = share * facts["all"]
    else:
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "value"))
        leaders = local.withColumn("_r", rank).where(F.col("_r") <= k).groupBy("value").agg(F.sum("n").alias("n"))
        top = leaders.orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("least"), F.count("*").alias("have")).first()
        bound = top["least"] if top["have"] == k else 0
    # a value whose sum on every node is below bound / nodes has a total below the bound
    fetched = written(local.where(F.col("n") >= bound / facts["nodes"]).select("value").distinct(), "candidates")
    few = fetched.count() <= broadcast_rows
    totals = local.join(F.broadcast(fetched) if few else fetched.hint("shuffle_hash"), "value", "left_semi").groupBy("value").agg(F.sum("n").alias("total"))
    return totals.where(F.col("total") >= bound) if share is not None else totals.orderBy(F.desc("total"), "value").limit(k)
