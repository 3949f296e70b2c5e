"""Loading comma-separated lines, with every line that fails set apart together with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merloom.functions.once import once

ORD, SEQ, WEIGHT = r"^[0-9]{1,18}\z", r"^[A-Za-z*-]+\z", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def _outside_ok(pieces: Column) -> Column:
    """Whether the text between quoted pieces is a delimiter, a doubled quote, or the line's edge, everywhere."""
    quotes, comma = F.size(pieces) - 1, F.lit(",")
    first, last = F.get(pieces, F.lit(0)), F.element_at(pieces, -1)
    middle = F.slice(pieces, 2, F.greatest(quotes - 1, F.lit(0)))
    bad = F.filter(middle, lambda x, i: (i % 2 == 1) & (x != "") & ~(F.startswith(x, comma) & F.endswith(x, comma)))
    edges = ((first == "") | F.endswith(first, comma)) & ((last == "") | F.startswith(last, comma))
    return (quotes == 0) | ((quotes % 2 == 0) & edges & (F.size(bad) == 0))


def _escaped(x: Column) -> Column:
    return F.replace(x, F.lit("\\"), F.lit("\\b"))


def _fields(pieces: Column) -> Column:
    """The fields of a well-quoted line. Commas inside quotes are written in an escape while the line is split at the others."""
    quotes = F.size(pieces) - 1
    middle = F.slice(pieces, 2, F.greatest(quotes - 1, F.lit(0)))
    kept = F.transform(middle, lambda x, i: F.when(i % 2 == 0, F.replace(_escaped(x), F.lit(","), F.lit("\\c"))).when(x == "", F.lit('"')).otherwise(_escaped(x)))
    ends = [F.array(_escaped(F.get(pieces, F.lit(0)))), F.when(quotes > 0, F.array(_escaped(F.element_at(pieces, -1)))).otherwise(F.array().cast("array<string>"))]
    split = F.split(F.array_join(F.concat(ends[0], kept, ends[1]), ""), ",", -1)
    return F.transform(split, lambda x: F.replace(F.replace(x, F.lit("\\c"), F.lit(",")), F.lit("\\b"), F.lit("\\")))


def parsed_rows(df: DataFrame, id_col: str = "raw_id", line_col: str = "line") -> DataFrame:
    """raw_id, fields and errors of every line that is no comment.

    `errors` has one entry for each rule that is broken, in the order quoting, columns, value:ord, value:name, value:seq,
    value:weight; it is empty for valid rows. One final carriage return is ignored. Every field is held as text until
    its rule has passed. A null line is like an empty one: it has one field where four are due.
    """
    line = F.coalesce(F.col(line_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("bigint").alias("raw_id"), F.when(F.endswith(line, F.lit("\r")), F.left(line, F.length(line) - 1)).otherwise(line).alias("line"))
    rows = rows.where(~F.startswith(F.col("line"), F.lit("#"))).select("raw_id", F.split("line", '"', -1).alias("pieces"))
    rows = once(rows, "pieces")
    quoted = _outside_ok(F.col("pieces"))
    rows = rows.select("raw_id", quoted.alias("quoted"), F.when(quoted, _fields(F.col("pieces"))).alias("fields"))
    rows = once(rows, "fields")
    field = [F.trim(F.get(F.col("fields"), F.lit(k))) for k in range(4)]
    weight = field[3].try_cast("double")
    four = F.size("fields") == 4
    rules = [
        F.when(~F.col("quoted"), "quoting"),
        F.when(F.col("quoted") & ~four, "columns"),
        F.when(F.col("quoted") & four & ~field[0].rlike(ORD), "value:ord"),
        F.when(F.col("quoted") & four & (field[1] == ""), "value:name"),
        F.when(F.col("quoted") & four & ~field[2].rlike(SEQ), "value:seq"),
        F.when(F.col("quoted") & four & ~F.coalesce(field[3].rlike(WEIGHT) & (weight > 0) & (weight < float("inf")), F.lit(False)), "value:weight"),
    ]
    return rows.select("raw_id", F.col("fields"), F.array_compact(F.array(*rules)).alias("errors"))


def valid_rows(df: DataFrame, id_col: str = "raw_id", line_col: str = "line") -> DataFrame:
    """raw_id, ord, name, seq, weight of the lines that break no rule; spaces at both ends of a field are dropped."""
    good = parsed_rows(df, id_col, line_col).where(F.size("errors") == 0)
    field = [F.trim(F.get(F.col("fields"), F.lit(k))) for k in range(4)]
    return good.select("raw_id", field[0].try_cast("bigint").alias("ord"), field[1].alias("name"), field[2].alias("seq"), field[3].try_cast("double").alias("weight"))


def failed_rows(df: DataFrame, id_col: str = "raw_id", line_col: str = "line") -> DataFrame:
    """raw_id, reason (`quoting`, `columns` or `value`, the first that applies) and all errors of the lines that break a rule. An empty table gives no rows; a repeated line fails each time."""
    bad = parsed_rows(df, id_col, line_col).where(F.size("errors") > 0)
    return bad.select("raw_id", F.split_part(F.get("errors", F.lit(0)), F.lit(":"), F.lit(1)).alias("reason"), "errors")
