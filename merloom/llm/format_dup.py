"""Records that are equal apart from the way they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merloom.functions.residues import chains
from merloom.operators.skew import salted_join
from merloom.storage import written


def canonical(df: DataFrame, id_col: str = "ord", seq_col: str = "seq", least: int = 20) -> DataFrame:
    """id and key of each row with at least `least` residues: upper case, letters only, chains in sorted order, hashed to 128 bits; `proof` is an independent 64-bit hash."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.array_join(chains(F.col(seq_col)), "|").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & (F.length(F.replace(F.col("text"), F.lit("|"), F.lit(""))) >= least))
    return rows.select("id", F.unhex(F.md5("text")).alias("key"), F.xxhash64("text").alias("proof"))


def format_groups(rows: DataFrame) -> DataFrame:
    """One row for each canonical form: keep (the smallest id), copies.

    Counted with map-side combining, so a form that holds a third of all rows sends one row a task. Forms whose 128-bit
    hashes collide differ in `proof` and stay apart.
    """
    return rows.groupBy("key", "proof").agg(F.min("id").alias("keep"), F.count("*").alias("copies"))


def format_copies(df: DataFrame, id_col: str = "ord", seq_col: str = "seq", least: int = 20) -> DataFrame:
    """keep, copy: one row for each record other than the one with the smallest id of its form.

    Rows with a null id or text, or with fewer than `least` residues, are no copies of anything; an id that occurs again
    within its form is no copy of itself. An empty table gives no rows.
    """
    rows = canonical(df, id_col, seq_col, least)
    groups = written(format_groups(rows).where("copies > 1").select(F.concat("key", F.unhex(F.hex("proof"))).alias("key"), "keep", "copies"), "forms")
    pairs = salted_join(rows.select("id", F.concat("key", F.unhex(F.hex("proof"))).alias("key")), groups, "key", "copies")
    return pairs.where("id <> keep").select("keep", F.col("id").alias("copy"))
