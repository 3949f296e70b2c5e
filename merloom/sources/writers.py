"""Sequence sets as files. Records are sorted by ord over range partitions, so files follow each other in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merloom.sources.readers import file_format


def wrapped(seq: Column, width: int = 0) -> Column:
    """The text in lines of `width` characters; 0 leaves it whole."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n") if width else seq


def _line(kind: str, width: int) -> Column:
    name, seq = F.coalesce("name", F.lit("")), F.coalesce("seq", F.lit(""))
    return {
        "fasta": F.concat(F.lit(">"), name, F.lit("\n"), wrapped(seq, width)),
        "mase": F.concat(F.lit(";\n"), name, F.lit("\n"), seq),
        "tbl": F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit("\t"), seq),
        "seq": seq,
        "names": name,
    }[kind]


def write_sequences(df: DataFrame, path: str, kind: str = "auto", width: int = 0) -> None:
    """Rows (ord, name, seq) in the format that the path's ending names (or `kind`, which must be the same); one folder with one file for each range of ord. ``.gz`` packs the files."""
    found = file_format(path)
    if kind not in ("auto", found):
        raise ValueError(f"{path} is {found}, not {kind}")
    if path.endswith(".xz"):
        raise ValueError("Spark can't write .xz")
    if found == "parquet":
        df.select("ord", "name", "seq").write.parquet(path)
        return
    lines = df.repartitionByRange("ord").sortWithinPartitions("ord").select(_line(found, width).alias("value"))
    (lines.write.option("compression", "gzip") if path.endswith(".gz") else lines.write).text(path)


def write_antigen_mers(table: DataFrame, path: str) -> None:
    """(k, mer, cnt, share) as tab-separated files, one folder for each antigen."""
    table.select("k", "mer", F.col("cnt").cast("bigint"), "share").write.partitionBy("k").option("sep", "\t").csv(path)
