"""Columns and generators for mers: the windows of fixed length of a sequence.

Texts are cut in two steps, first into overlapping chunks and then into mers, as a substring of a long UTF-8 text costs
time in proportion to its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merloom.functions.once import once

CHUNK = 256
GAP, BAD = "-", "x"


def _range(n: Column, step: int = 1) -> Column:
    """0, step, 2 * step, ... below n; empty if n is null or below 1."""
    return F.when(n >= 1, F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))


def mers(seq: Column, e: int, rmdash: bool = True, rmx: bool = True) -> Column:
    """All windows of e characters in order: without gaps first (rmdash), those with the bad character left out (rmx). Short and null texts have none."""
    text = F.replace(seq, F.lit(GAP), F.lit("")) if rmdash else seq
    chunks = F.transform(_range(F.length(text) - e + 1, CHUNK), lambda i: F.substring(text, i + 1, F.lit(CHUNK + e - 1)))
    found = F.flatten(F.transform(chunks, lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - e + 1), lambda i: F.substring(c, i, F.lit(e)))))
    return F.filter(found, lambda m: ~F.contains(m, F.lit(BAD))) if rmx else found


def mer_set(seq: Column, e: int, rmdash: bool = True, rmx: bool = True) -> Column:
    return F.array_distinct(mers(seq, e, rmdash, rmx))


def tiled_mers(seq: Column, k: int, stride: int = 1) -> Column:
    """Distinct windows at every stride-th place; the last may be shorter than k. No gap or bad character is looked at."""
    tiles = max(1, CHUNK // stride)
    count = F.ceil(1 + (F.length(seq) - k) / stride).cast("int")
    chunks = F.transform(_range(count, tiles), lambda n: F.substring(seq, n * stride + 1, F.lit((tiles - 1) * stride + k)))
    inner = F.transform(chunks, lambda c: F.transform(_range(F.ceil(1 + (F.length(c) - k) / stride).cast("int")), lambda n: F.substring(c, n * stride + 1, F.lit(k))))
    return F.array_distinct(F.flatten(inner))


def mers_to_text(path: Column) -> Column:
    """The text whose windows the mers are: the first character of each, then the rest of the last."""
    heads = F.array_join(F.transform(path, lambda m: F.left(m, F.lit(1))), "")
    return F.when(F.size(path) > 0, F.concat(heads, F.substring(F.element_at(path, -1), 2, 1 << 30))).otherwise("")


def hamming(a: Column, b: Column) -> Column:
    """Places at which two texts of one length differ; other lengths raise."""
    apart = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x))
    return F.when(F.length(a) != F.length(b), F.raise_error("texts of different length").cast("int")).when((F.length(a) == 0), 0).otherwise(apart)


def cyclic_key(mer: Column, k: Column | int, size: int) -> Column:
    """`size` characters of the mer written twice, from place k."""
    return F.substring(F.concat(mer, mer), (F.lit(k) if isinstance(k, int) else k) + 1, F.lit(size))


def characters(seq: Column) -> Column:
    """The characters of a text; an empty text has none."""
    return F.filter(F.split(seq, ""), lambda c: c != "")


def residue_places(seq: Column) -> Column:
    """Places (from 0) of the characters that are no gap."""
    return F.array_compact(F.transform(characters(seq), lambda c, p: F.when(c != GAP, p)))


def places_of(seq: Column, c: str) -> Column:
    """Places (from 0) of a character."""
    return F.array_compact(F.transform(characters(seq), lambda x, p: F.when(x == c, p)))


def gapped_rows(df: DataFrame, e: int, keep: list[str], gapped: bool = False) -> DataFrame:
    """One row for each window of e residues of each row, with the columns `keep`: pos (its first column), mer (its residues) and with `gapped` the text between first and last residue with its gaps.

    Characters and places are worked out once a row, and no text is cut at a far place.
    """
    rows = once(df.select(*dict.fromkeys(keep), characters(F.col("seq")).alias("_ch")), "_ch")
    at = F.array_compact(F.transform("_ch", lambda c, p: F.when(c != GAP, p)))
    rows = once(rows.select(*keep, "_ch", at.alias("_at"), F.array_join(F.filter("_ch", lambda c: c != GAP), "").alias("_bare")), "_at")
    count = F.greatest(F.size("_at") - e + 1, F.lit(0))
    bare = mers(F.col("_bare"), e, False, False)
    if not gapped:
        found = F.zip_with(F.slice("_at", F.lit(1), count), bare, lambda a, m: F.struct(a.alias("pos"), m.alias("mer")))
    else:
        ends = F.zip_with(F.slice("_at", F.lit(1), count), F.slice("_at", F.lit(e), count), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        found = F.zip_with(ends, bare, lambda p, m: F.struct(p["a"].alias("pos"), m.alias("mer"), F.array_join(F.slice("_ch", p["a"] + 1, p["b"] - p["a"] + 1), "").alias("gapped")))
    return rows.select(*keep, F.explode(found).alias("_g")).select(*keep, "_g.*")


def relative_name(master: Column, mutant: Column, match: str = ".") -> Column:
    """The mutant with a sign for each character that equals the master's; as long as the shorter one."""
    signs = F.zip_with(characters(master), characters(mutant), lambda a, b: F.when(a.isNull() | b.isNull(), "").when(a == b, match).otherwise(b))
    return F.array_join(signs, "")


def repeated_mers(seq: Column, e: int) -> Column:
    """The distinct mers that occur more than once in the text, sorted."""
    m = F.array_sort(mers(seq, e))
    same = F.zip_with(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), m, lambda x, y: F.when(x == y, x))
    return F.array_distinct(F.array_compact(same))


def exploded(df: DataFrame, seq: str, e: int, keep: list[str], distinct: bool = True, rmdash: bool = True, rmx: bool = True) -> DataFrame:
    """One row for each mer of each row, with the columns `keep`; with `distinct` each mer once a row, without a shuffle."""
    df = once(df.select(*dict.fromkeys([*keep, seq])), seq)
    array = mer_set(F.col(seq), e, rmdash, rmx) if distinct else mers(F.col(seq), e, rmdash, rmx)
    return df.select(*keep, F.explode(array).alias("mer"))
