"""Columns that clean sequence text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def residues(seq: Column) -> Column:
    """The letters A-Z of the upper-cased text in order; null stays null."""
    return F.regexp_replace(F.upper(seq), "[^A-Z]+", "")


def chains(seq: Column) -> Column:
    """The sorted residues of the pieces between ``|``, ``;`` and ``/``; pieces without residues are left out."""
    pieces = F.split(F.regexp_replace(F.upper(seq), "[^A-Z|;/]+", ""), "[|;/]+")
    return F.sort_array(F.filter(pieces, lambda x: F.length(x) > 0))
