"""python -m merloom.cli COMMAND population [antigens] ...: the programs as one command each; results are written as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merloom.operators import coverage, filters, greedy, tally
from merloom.plans.design import Design, design
from merloom.session import ship
from merloom.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="merloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("micro", "share of mer counts covered, by antigen and distance"), ("macro", "mean share of a sequence's mers missed"), ("sites", "share of sequences missed by alignment column"), ("counts", "counts of each antigen's mers"), ("bootstrap", "error of the covered share")):
        c = sub.add_parser(name, help=text)
        c.add_argument("population")
        c.add_argument("antigens")
    c = sub.add_parser("design", help="complementary sequences of the largest coverage")
    c.add_argument("population")
    c.add_argument("-M", type=int, default=3, help="sequences to design")
    c.add_argument("-T", type=int, default=1, help="trials")
    c.add_argument("--extra", type=int, default=0, help="turns after the first M in which sequences are replaced")
    c.add_argument("--fixed", help="file of sequences that come first and stay")
    c.add_argument("--hints", help="file of sequences to start the first trial with")
    c.add_argument("--names", nargs="*", default=[], help="names of the first sequences designed")
    c.add_argument("--low", type=float, default=0, help="mers with counts up to this are left out")
    c.add_argument("--cost", default="rss", help="edge cost for cycle removal")
    c = sub.add_parser("top", help="long mers that hold the most short ones")
    c.add_argument("population")
    c.add_argument("-K", type=int, default=15)
    c.add_argument("-N", type=int, default=10)
    c.add_argument("--reduce", action="store_true", help="pick from the best quarter of the pool")
    c.add_argument("--initial", help="file of sequences whose tiles are picked first")
    c.add_argument("--trials", type=int, default=0, help="trials of each round that improves the picks")
    for c in sub.choices.values():
        c.add_argument("--out", required=True, help="folder of the result; a sequence file's ending for design")
        c.add_argument("-E", type=int, default=9, help="mer length")
        c.add_argument("-d", type=int, default=1, help="largest Hamming distance (micro, bootstrap)")
        c.add_argument("--weights", help="file of weights")
        c.add_argument("--first", type=int, default=0, help="antigens to read; 0 reads all")
        c.add_argument("--bad-in-total", action="store_true", help="count mers with the bad character in the total (micro)")
        c.add_argument("--tmr", type=int, default=0, help="sequences with so many repeated mers are left out")
        c.add_argument("--seed", type=int, default=1)
    return p


def _texts(spark: SparkSession, path: str | None) -> list[str]:
    """The sequences of a small file (at most 10,000) in order."""
    if not path:
        return []
    found = [r["seq"] for r in readers.read_sequences(spark, path).orderBy("ord").limit(10_001).collect()]
    if len(found) > 10_000:
        raise ValueError(f"{path} holds more than 10,000 sequences")
    return found


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The table that a command gives."""
    gaps = a.command == "sites"
    rows = readers.read_sequences(spark, a.population, rmdash=not gaps, badchar=None if a.command == "top" else "x")
    rows = filters.few_repeats(rows, a.E, a.tmr, "le" if a.command == "top" else "lt")
    weights = tally.weight_table(readers.read_weights(spark, a.weights)) if a.weights else None
    if a.command == "design":
        fixed, hints = (_texts(spark, f) for f in (a.fixed, a.hints))
        return design(rows, Design(e=a.E, m=a.M, trials=a.T, low_nodes=a.low, cost=a.cost, seed=a.seed, extra=a.extra, fixed=fixed, hints=hints, names=a.names), weights)
    if a.command == "top":
        initial = readers.read_sequences(spark, a.initial) if a.initial else None
        return greedy.top_mers(rows, a.K, a.E, a.N, a.reduce, initial, a.trials, a.seed)
    antigens = filters.first_rows(readers.read_sequences(spark, a.antigens, rmdash=True, badchar="x"), a.first)
    if a.command == "micro":
        return coverage.offby_shares(rows, antigens, a.E, a.d, a.bad_in_total)
    if a.command == "macro":
        return coverage.macro_curve(rows, antigens, a.E, weights, strict=weights is not None)
    if a.command == "sites":
        return coverage.site_curve(rows, antigens, a.E)
    if a.command == "counts":
        return coverage.antigen_mers(rows, antigens, a.E, weights)
    return coverage.offby_bootstrap(rows, antigens, a.E, a.d, seed=a.seed)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    out = result(spark, a)
    if a.command == "design" and "." in a.out.rpartition("/")[2]:
        writers.write_sequences(out.select(F.col("path_id").cast("bigint").alias("ord"), "name", "seq"), a.out)
    else:
        out.write.parquet(a.out)


if __name__ == "__main__":
    main()
