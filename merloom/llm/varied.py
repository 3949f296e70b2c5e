"""A varied subset of given size: round-robin over the cells of a grid of features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merloom.functions.residues import residues
from merloom.storage import written

#: Requests at most; their tables are broadcast.
REQUESTS = 10_000
#: Clade codes share this many bins; with the bins of the other features the grid has at most 512 * 16 * 4 * 4 cells.
CLADE_BINS, LENGTH_BINS, SHARE_BINS = 512, 16, 4


def clade(name: Column) -> Column:
    """The clade code in a name: its second part where parts stand between ``|``, else the part before the first ``.`` or ``_``; '' if there is none."""
    n = F.upper(F.trim(name))
    code = F.when(F.contains(n, F.lit("|")), F.trim(F.split_part(n, F.lit("|"), F.lit(2)))).when(n.rlike("[._]"), F.regexp_substr(n, F.lit("^[^._]*")))
    return F.coalesce(F.when(code.rlike("^[A-Z][A-Z0-9]{0,7}$"), code), F.lit(""))


def _bin(text: Column, bins: int) -> Column:
    """A bin by the text's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(bins)).cast("int")


def length_steps(least: int) -> list[int]:
    """The lengths at which the length bins after the first begin: four for each doubling from `least` on."""
    return [math.ceil(least * 2 ** (k / 4)) for k in range(1, LENGTH_BINS)]


def _share(text: Column, letters: str) -> Column:
    return F.least(F.floor((1 - F.length(F.translate(text, letters, "")) / F.greatest(F.length(text), F.lit(1))) * 2 * SHARE_BINS), F.lit(SHARE_BINS - 1)).cast("int")


def _numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with their number within the group, from 1, in this order. Numbers come from range partitions: the number within the partition, and the sizes of the parts of the group before it, so a hot group is spread over many tasks."""
    rows = written(rows.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy(group, "part").agg(F.count("*").alias("n"))
    before = sizes.select(group, "part", (F.sum("n").over(Window.partitionBy(group).orderBy("part")) - F.col("n")).alias("before")).where("before > 0")
    local = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))
    # a partition begins with at most one group that has parts before it
    return rows.withColumn("local", local).join(F.broadcast(before), [group, "part"], "left").withColumn(name, F.col("local") + F.coalesce("before", F.lit(0))).drop("part", "local", "before")


def grid(df: DataFrame, id_col: str = "ord", name_col: str = "name", seq_col: str = "seq", least: int = 20, whole: bool = False) -> DataFrame:
    """id, clade, cell, copy, mix: one row for each distinct residue text of at least `least` residues, at its smallest id, with copy 1.

    With `whole` one row for each row with an id: copy numbers those of one text by id, and texts of fewer than `least`
    residues, empty and null ones have a cell of their own.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), clade(F.col(name_col)).alias("clade"), F.coalesce(residues(F.col(seq_col)), F.lit("")).alias("text")).where(F.col("id").isNotNull())
    full = F.length("text") >= least
    bins = (rows if whole else rows.where(full)).select(
        "id",
        "clade",
        F.when(full, _bin(F.col("clade"), CLADE_BINS)).otherwise(-1).alias("b0"),
        F.when(full, sum((F.length("text") >= n).cast("int") for n in length_steps(least))).otherwise(-1).alias("b1"),
        F.when(full, _share(F.col("text"), "AVILMFWYC")).otherwise(-1).alias("b2"),
        F.when(full, _share(F.col("text"), "DEKRH")).otherwise(-1).alias("b3"),
        F.unhex(F.md5("text")).alias("key"),
    )
    if whole:
        cell = F.struct(*(F.col(f"b{k}") for k in range(4)))
        return _numbered(bins, "key", ["id"], "copy").select("id", "clade", cell.alias("cell"), "copy", F.col("key").alias("mix"))
    one = bins.groupBy("key").agg(F.min(F.struct("id", "clade", "b0", "b1", "b2", "b3")).alias("r"))
    cell = F.struct(*(F.col(f"r.b{k}") for k in range(4)))
    return one.select("r.id", "r.clade", cell.alias("cell"), F.lit(1).alias("copy"), F.col("key").alias("mix"))


def numbered_cells(points: DataFrame) -> DataFrame:
    """cell, size, cell_no: cells in turn over the clades, the largest cell of each first. The grid bounds the number of cells, so these windows are small."""
    sizes = points.groupBy("cell").agg(F.count("*").alias("size"))
    turn = F.row_number().over(Window.partitionBy("cell.b0").orderBy(F.desc("size"), F.md5(F.concat_ws(":", "cell.b0", "cell.b1", "cell.b2", "cell.b3"))))
    return sizes.withColumn("turn", turn).withColumn("cell_no", F.row_number().over(Window.orderBy("turn", F.md5(F.col("cell.b0").cast("string"))))).drop("turn")


def varied_order(df: DataFrame, id_col: str = "ord", name_col: str = "name", seq_col: str = "seq", least: int = 20, whole: bool = False) -> DataFrame:
    """id, clade, cell_no, rank_in_cell of every distinct record (with `whole` of every row): a varied subset of any size k is the first k by rank_in_cell, then cell_no.

    Within a cell the first row of each text comes before the second of any. A cell that holds a third of all records is
    spread over many tasks.
    """
    points = written(grid(df, id_col, name_col, seq_col, least, whole), "grid")
    ranked = _numbered(points, "cell", ["copy", "mix", "id"], "rank_in_cell").join(F.broadcast(numbered_cells(points)), "cell")
    return ranked.select("id", "clade", "cell_no", "rank_in_cell")


def varied_subsets(df: DataFrame, requests: DataFrame, id_col: str = "ord", name_col: str = "name", seq_col: str = "seq", request_col: str = "request_id", amount_col: str = "amount", least: int = 20, whole: bool = False) -> DataFrame:
    """request_id, rank_in_cell, cell_no, id, clade: for each request that many records.

    Records with equal residues count once. Records are ranked within their cell by a hash of the text; the order is by
    rank, then cell, cells in turn over the clades. The place of a record in that order follows from its rank and the
    sizes of the cells alone, so no task sees all records. Requests with a null amount or one below 1 get no rows; one
    for more than there are distinct texts gets all of these. Null names have the clade ''; rows without an id or with
    fewer than `least` residues are never chosen. With `whole` each row with an id can be chosen: copies of a text have
    later ranks, short and empty texts a cell of their own, and a request gives as many records as it asks for or there are.
    More than REQUESTS different requests are an error.
    """
    points = written(grid(df, id_col, name_col, seq_col, least, whole), "grid")
    cells = written(numbered_cells(points), "cells")
    by_size = Window.orderBy("size", "cell_no")
    steps = cells.select("size", (F.count("*").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.row_number().over(by_size) + 1).alias("open"), (F.sum("size").over(by_size) - F.col("size")).alias("closed"))
    wanted = requests.select(F.col(request_col).alias("request_id"), F.col(amount_col).cast("bigint").alias("amount")).where("amount >= 1").distinct().limit(REQUESTS + 1)
    wanted = written(wanted, "requests")
    if wanted.count() > REQUESTS:
        raise ValueError(f"more than {REQUESTS:,} requests")
    # with r full rounds, the cells of fewer than r records give all they have and the open ones r each
    step = F.min(F.when(F.col("size").isNotNull(), F.struct("size", "closed", "open")))
    last = wanted.join(F.broadcast(steps), F.col("closed") + F.col("open") * F.col("size") >= F.col("amount"), "left").groupBy("request_id", "amount").agg(step.alias("s"))
    last = last.withColumn("rounds", F.ceil((F.col("amount") - F.col("s.closed")) / F.col("s.open")).cast("bigint"))
    last = last.select("request_id", "amount", F.coalesce("rounds", cells.agg(F.max("size")).scalar()).alias("rounds"), F.coalesce(F.col("s.closed") + F.col("s.open") * (F.col("rounds") - 1), F.lit(0)).alias("before"))
    last = written(last, "rounds")
    limit = last.agg(F.max("rounds")).first()[0] or 0
    ranked = _numbered(points, "cell", ["copy", "mix", "id"], "rank_in_cell").where(F.col("rank_in_cell") <= limit)
    placed = ranked.join(F.broadcast(cells), "cell")
    # the place of each open cell in the last round
    open_cells = cells.select("cell_no", F.col("size")).join(F.broadcast(last.select("request_id", "rounds")), F.col("size") >= F.col("rounds"))
    final = open_cells.select("request_id", "cell_no", F.row_number().over(Window.partitionBy("request_id").orderBy("cell_no")).alias("place"))
    chosen = placed.join(F.broadcast(last), F.col("rank_in_cell") <= F.col("rounds")).join(F.broadcast(final), ["request_id", "cell_no"], "left")
    chosen = chosen.where((F.col("rank_in_cell") < F.col("rounds")) | (F.col("before") + F.col("place") <= F.col("amount")))
    return chosen.select("request_id", "rank_in_cell", "cell_no", "id", "clade")
