"""How often every fixed-length term occurs, and in how many records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merloom.functions.residues import residues
from merloom.llm.ragged import row_slices, spread, text_bytes
from merloom.storage import written


def _counts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Per batch: term number, occurrences, records; the number -1 stands for records that hold a term at all."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for lo, hi in row_slices(offsets, 1 << 21):
            o = offsets[lo : hi + 1] - offsets[lo]
            codes = data[offsets[lo] : offsets[hi]].astype(np.int64) - 65
            counts = np.maximum(np.diff(o) - width + 1, 0)
            if not counts.any():
                continue
            value = np.zeros(max(len(codes) - width + 1, 0), np.int64)
            for k in range(width):
                value = value * 26 + codes[k : k + len(value)]
            value = value[spread(o[:-1], counts)]
            record = np.repeat(np.arange(hi - lo), counts)
            space = 26**width
            if space <= len(value) * 4:
                # few terms are possible: counted in place
                all_times = np.bincount(value, minlength=space)
                term = np.flatnonzero(all_times)
                times = all_times[term]
                key = np.sort(record * space + value)
                records = np.bincount(key[np.r_[True, key[1:] != key[:-1]]] % space, minlength=space)[term]
            else:
                ordered = np.sort(value)
                first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                term, times = ordered[first], np.diff(np.r_[first, len(ordered)])
                key = np.sort(record * len(term) + np.searchsorted(term, value))
                records = np.bincount(key[np.r_[True, key[1:] != key[:-1]]] % len(term), minlength=len(term))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[term, -1]), pa.array(np.r_[times, 0].astype(np.int64)), pa.array(np.r_[records, np.count_nonzero(counts)].astype(np.int64))], ["term", "times", "records"])


def term_counts(df: DataFrame, seq_col: str = "seq", width: int = 4, rare: int = 2, common: float = 0.05) -> DataFrame:
    """mer, count, records, mark for every term of `width` residues (at most 13): `rare` in at most `rare` records, else `common` in at least the share `common` of the records that hold a term, else null.

    Null, empty and short texts hold no term. A repeated row counts as a record of its own. Each task sums the terms of
    a batch before the shuffle, so a term in every record costs one row a batch. An empty table gives no rows.
    """
    if not 1 <= width <= 13:
        raise ValueError("width must be from 1 to 13")
    parts = df.select(residues(F.col(seq_col)).alias("text")).where(F.length("text") >= width).mapInArrow(lambda it: _counts(it, width), "term bigint, times bigint, records bigint")
    sums = parts.groupBy("term").agg(F.sum("times").alias("count"), F.sum("records").alias("records"))
    sums = written(sums, "terms")
    total = sums.where("term = -1").agg(F.max("records")).scalar()
    letters = [F.char(F.floor(F.col("term") / 26 ** (width - 1 - k)) % 26 + 65) for k in range(width)]
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") >= common * total, "common")
    return sums.where("term >= 0").select(F.concat(*letters).alias("mer"), "count", "records", mark.alias("mark"))
