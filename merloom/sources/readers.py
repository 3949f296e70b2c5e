"""Sequence files as DataFrames (ord, name, seq); ord follows the files and the records in them."""

from __future__ import annotations

import lzma
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merloom.storage import written

#: File name endings of each format; each may be followed by .gz or .xz.
ENDINGS = {"fasta": ("fasta", "fa", "fst", "fna", "faa"), "mase": ("mase",), "tbl": ("tbl", "table"), "seq": ("seq",), "names": ("nm",), "parquet": ("parquet",)}


def file_format(path: str) -> str:
    """The format that a path's ending names; the packing is peeled off first (case counts), then case is ignored."""
    name = re.sub(r"\.(gz|xz)$", "", path.rstrip("/"))
    ending = name.rpartition(".")[2].lower()
    for kind, endings in ENDINGS.items():
        if ending in endings:
            return kind
    raise ValueError(f"no format known for {path}")


def _records(spark: SparkSession, path: str, separator: str | None) -> DataFrame:
    """value and place of each record, in order of place (file, then record)."""
    if path.endswith(".xz"):
        files = spark.read.format("binaryFile").load(path).select("path", "content")

        def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for name, content in zip(part["path"], part["content"], strict=True):
                    records = lzma.decompress(content).decode().split(separator or "\n")
                    yield pd.DataFrame({"value": records if records[-1] else records[:-1], "file": name, "n": range(len(records) - (not records[-1]))})

        # a packed file of this kind can't be split: one task a file
        return files.mapInPandas(unpack, "value string, file string, n bigint").select("value", F.struct("file", "n").alias("place"))
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return reader.text(path).select("value", where.alias("place"))


def _in_order(df: DataFrame) -> DataFrame:
    """ord from the place, unique and rising: rows are range-partitioned by place and numbered by partition."""
    # written, as the numbers of partitions must be the same whenever the rows are read
    parts = written(df.repartitionByRange("place").withColumn("_p", F.spark_partition_id()), "places")
    n = F.row_number().over(Window.partitionBy("_p").orderBy("place")) - 1
    return parts.withColumn("ord", F.shiftleft(F.col("_p").cast("bigint"), 40) + n).select("ord", "name", "seq")


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "[\\r\\t]+", " "))), "")


def read_fasta(spark: SparkSession, path: str, check: bool = False) -> DataFrame:
    """Records from ``>`` on; the name is the rest of that line, the lines after it are trimmed and joined. With `check`, text before a file's first ``>`` raises (this ranks the records of each file)."""
    records = _records(spark, path, "\n>")
    first = F.startswith("value", F.lit(">"))
    lines = F.split(F.when(first, F.substring("value", 2, 1 << 30)).otherwise(F.col("value")), "\n")
    head = F.rtrim(F.regexp_replace(F.get(lines, F.lit(0)), "\\r", ""))
    opens = F.lit(False) if path.endswith(".xz") else F.col("place.block") == 0
    # a file's first record is the one that keeps its sign; one record a file may do so
    lost = opens & ~first & (F.row_number().over(Window.partitionBy("place.file").orderBy("place")) == 1) if check else F.lit(False)
    parsed = records.select("place", F.when(lost, F.raise_error("text before the first header")).otherwise(head).alias("name"), _joined(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("seq"))
    return _in_order(parsed)




def read_mase(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``;`` are comments and end a record; the next line is the name, the others are joined."""
    records = _records(spark, path, "\n;")
    lines = F.split("value", "\n")
    body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x) != "")
    rows = records.select("place", body.alias("body")).where(F.size("body") > 0)
    return _in_order(rows.select("place", F.trim(F.get("body", F.lit(0))).alias("name"), _joined(F.slice("body", 2, F.greatest(F.size("body") - 1, F.lit(0)))).alias("seq")))


def read_tbl(spark: SparkSession, path: str) -> DataFrame:
    """``name<tab>seq`` lines, or with white space where a line has no tab: the first and the last token; ``#`` starts a comment line."""
    line = F.trim(F.regexp_replace("value", "^#.*|\\r$", ""))
    rows = _records(spark, path, None).select("place", line.alias("line")).where("line <> ''")
    tokens = F.when(F.contains("line", F.lit("\t")), F.split("line", "\t")).otherwise(F.split("line", "\\s+"))
    return _in_order(rows.select("place", F.element_at(tokens, 1).alias("name"), F.element_at(tokens, -1).alias("seq")))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """One sequence a line, without names; blank lines are left out."""
    return _in_order(_records(spark, path, None).select("place", F.lit("").alias("name"), F.trim("value").alias("seq")).where("seq <> ''"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name a line, without sequences."""
    return _in_order(_records(spark, path, None).select("place", F.trim(F.regexp_replace("value", "^>\\s*", "")).alias("name"), F.lit("").alias("seq")))


READERS = {"fasta": read_fasta, "mase": read_mase, "tbl": read_tbl, "seq": read_raw, "names": read_names, "parquet": lambda spark, path: spark.read.parquet(path).select("ord", "name", "seq")}


def read_sequences(spark: SparkSession, path: str, kind: str = "auto", **filters) -> DataFrame:
    """A sequence file of the kind its ending names, with the filters of operators.filters.filtered()."""
    from merloom.operators.filters import filtered

    found = file_format(path)
    if kind != "auto" and kind != found:
        raise ValueError(f"{path} is {found}, not {kind}")
    rows = READERS[found](spark, path)
    return filtered(rows, **filters) if filters else rows


def read_weights(spark: SparkSession, path: str | None) -> DataFrame:
    """line_no, weight, name of ``value name`` lines; ``#`` starts a comment. A line with another number of tokens raises. No path gives no rows."""
    schema = "line_no bigint, weight double, name string"
    if not path:
        return spark.createDataFrame([], schema)
    rows = _records(spark, path, None).select("place", F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")
    tokens = F.split("line", "\\s+")
    ok = F.when(F.size(tokens) == 2, tokens).otherwise(F.raise_error("a line of weights needs two tokens").cast("array<string>"))
    numbered = _in_order(rows.select("place", F.get(ok, F.lit(1)).alias("name"), F.get(ok, F.lit(0)).alias("seq")))
    return numbered.select(F.col("ord").alias("line_no"), F.col("seq").cast("double").alias("weight"), "name")
