"""The core's queries over the tables of one folder, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merloom.functions import mers as M
from merloom.functions.once import once
from merloom.functions.residues import residues
from merloom.operators import acyclic, columns, compact, coverage, decycle, filters, graph, greedy, offby, paths, raw_rows, tally
from merloom.plans.design import Design, design
from merloom.plans.design_runs import design_table
from merloom.sources import readers, writers
from merloom.storage import exists, shared_dir, spread, written
from merloom.streaming.tally import windowed_tally

#: Lengths of short and long mers.
E, K = 9, 15


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(table) if name in ("sequences", "raw_rows") else table


def _population(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "sequences").where("seq is not null").select("ord", "name", residues(F.col("seq")).alias("seq"))


def _antigens(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "antigens").where("seq is not null").select("ord", "name", residues(F.col("seq")).alias("seq"))


def _gapped(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "sequences").where("seq is not null").select("ord", "name", F.regexp_replace(F.upper("seq"), "[^A-Z-]", "").alias("seq"))


def _plain(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "sequences").where("seq is not null").select("ord", "name", F.regexp_replace("seq", "[^ -~]", "").alias("seq"))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("name"), F.col("c_name").alias("seq"))


def _with_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d).withColumn("seq", F.translate("seq", "0e", "--"))


def mer_tally(spark: SparkSession, d: str) -> DataFrame:
    return tally.mer_tally(_population(spark, d), E)


def mer_tally_weighted(spark: SparkSession, d: str) -> DataFrame:
    weights = tally.weight_table(_t(spark, d, "weights"))
    return tally.weighted_tally(_population(spark, d), weights, E).withColumn("cnt", F.round("cnt", 6))


def mer_total_bad(spark: SparkSession, d: str) -> DataFrame:
    rows = _population(spark, d).withColumn("seq", F.translate("seq", "X", "x"))
    with_bad, good = (tally.tally_total(rows, E, b).withColumn("bad", F.lit(b)) for b in (True, False))
    return with_bad.unionByName(good)


def end_mers(spark: SparkSession, d: str) -> DataFrame:
    return tally.end_mers(_population(spark, d), E)


def filter_name_pattern(spark: SparkSession, d: str) -> DataFrame:
    return filters.by_pattern(_population(spark, d), "^BB[CD]", "clone|_").select("ord", "name")


def filter_name_list(spark: SparkSession, d: str) -> DataFrame:
    return filters.by_patterns(_population(spark, d), ["^bbc", "hb"], keepfirst=True).select("ord", "name")


def filter_name_exclude(spark: SparkSession, d: str) -> DataFrame:
    return filters.by_patterns(_population(spark, d), ["^u", "hb"], exclude=True).select("ord", "name")


def clean_sequence(spark: SparkSession, d: str) -> DataFrame:
    rows = _plain(spark, d)
    return rows.select("ord", filters.truncated(filters.cleaned(F.col("seq"), True, True, "x", True), 0, 60).alias("seq"))


def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return filters.first_of_each(_population(spark, d)).select("ord", "seq")


def max_seqs(spark: SparkSession, d: str) -> DataFrame:
    return filters.filtered(_plain(spark, d), pattern="^BB", rmdash=True, badchar="x", rmdup=True, maxseqs=100)


def repeat_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.few_repeats(_population(spark, d), 3, 4).select("ord")


def design_rows(spark: SparkSession, d: str) -> DataFrame:
    long = _population(spark, d).where(F.length("seq") >= 30)
    return filters.design_filter(long, E, reverse=True, tmr=3, span=(5, 25)).select("ord", "seq")


def duplicated_mers(spark: SparkSession, d: str) -> DataFrame:
    return once(_population(spark, d), "seq").select("ord", F.explode(M.repeated_mers(F.col("seq"), 4)).alias("mer"))


def tiled_kmers(spark: SparkSession, d: str) -> DataFrame:
    return greedy.tiles(_population(spark, d), K, E)


def length_stats(spark: SparkSession, d: str) -> DataFrame:
    return tally.length_stats(_population(spark, d))


def micro_coverage_curve(spark: SparkSession, d: str) -> DataFrame:
    return coverage.micro_curve(_population(spark, d), _antigens(spark, d), E).withColumn("share", F.round("share", 9))


def macro_coverage_curve(spark: SparkSession, d: str) -> DataFrame:
    return coverage.macro_curve(_population(spark, d), _antigens(spark, d), E).withColumn("missed", F.round("missed", 6))


def macro_coverage_weighted(spark: SparkSession, d: str) -> DataFrame:
    weights = tally.weight_table(_t(spark, d, "weights"))
    return coverage.macro_curve(_population(spark, d), _antigens(spark, d), E, weights).withColumn("missed", F.round("missed", 6))


def antigen_mer_counts(spark: SparkSession, d: str) -> DataFrame:
    return coverage.antigen_mers(_population(spark, d), _antigens(spark, d), E).withColumn("share", F.round("share", 9))


def rarest_mers(spark: SparkSession, d: str) -> DataFrame:
    return coverage.rarest(_population(spark, d), _antigens(spark, d), E)


def offby_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage.offby_curve(_population(spark, d), _antigens(spark, d), E, 2)


def near_mers(spark: SparkSession, d: str) -> DataFrame:
    own = coverage.first_antigen(_antigens(spark, d), E)
    return offby.neighbours(tally.mer_tally(_population(spark, d), E), own, E, 2)


def bootstrap_coverage(spark: SparkSession, d: str) -> DataFrame:
    curve = coverage.bootstrap(_population(spark, d), _antigens(spark, d), E)
    return curve.select("k", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def bootstrap_offby(spark: SparkSession, d: str) -> DataFrame:
    curve = coverage.offby_bootstrap(_population(spark, d), _antigens(spark, d), E, 1)
    return curve.select("k", "dist", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def positional_tally(spark: SparkSession, d: str) -> DataFrame:
    return tally.place_tally(_gapped(spark, d), E)


def ref_site_tally(spark: SparkSession, d: str) -> DataFrame:
    return tally.site_tally(_gapped(spark, d), E)


def mer_positions(spark: SparkSession, d: str) -> DataFrame:
    return tally.mer_places(_gapped(spark, d), E).withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


def gapped_places(spark: SparkSession, d: str) -> DataFrame:
    return tally.gapped_places(_gapped(spark, d), E)


def residue_maps(spark: SparkSession, d: str) -> DataFrame:
    return tally.residue_map(_gapped(spark, d)).withColumn("places", F.array_join(F.transform("places", lambda p: p.cast("string")), ","))


def site_missed(spark: SparkSession, d: str) -> DataFrame:
    return coverage.site_curve(_gapped(spark, d), _antigens(spark, d), E).withColumn("missed", F.round("missed", 6))


def site_means(spark: SparkSession, d: str) -> DataFrame:
    return coverage.site_means(coverage.site_curve(_gapped(spark, d), _antigens(spark, d), E)).withColumn("missed", F.round("missed", 6))


def site_entropy(spark: SparkSession, d: str) -> DataFrame:
    return columns.entropy(_gapped(spark, d)).withColumn("entropy", F.round("entropy", 6))


def site_entropy_weighted(spark: SparkSession, d: str) -> DataFrame:
    rows = tally.weighted(_population(spark, d), tally.weight_table(_t(spark, d, "weights")))
    return columns.entropy(rows, True, F.col("weight")).withColumn("entropy", F.round("entropy", 6))


def consensus(spark: SparkSession, d: str) -> DataFrame:
    return columns.consensus(_aligned(spark, d))


def gap_columns(spark: SparkSession, d: str) -> DataFrame:
    return columns.gap_columns(_with_gaps(spark, d))


def strip_gap_columns(spark: SparkSession, d: str) -> DataFrame:
    return columns.without_gap_columns(_with_gaps(spark, d)).select("ord", "seq")


def strip_master_columns(spark: SparkSession, d: str) -> DataFrame:
    return columns.without_master_gaps(_with_gaps(spark, d)).select("ord", "seq")


def column_values(spark: SparkSession, d: str) -> DataFrame:
    return columns.column(_population(spark, d).where(F.length("seq") >= 20), [0, 4, 19])


def relative_names(spark: SparkSession, d: str) -> DataFrame:
    rows = _aligned(spark, d)
    master = rows.agg(F.min_by("seq", "ord")).first()[0] or ""
    return rows.select("ord", M.relative_name(F.lit(master), F.col("seq")).alias("relative"))


_kept: dict[tuple, tuple[DataFrame, ...]] = {}


def _once(spark: SparkSession, d: str, name: str, make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """The written tables that make() gives, made once for the same files in one application, while they are there."""
    key = (spark.sparkContext.applicationId, name, *sorted(_t(spark, d, "sequences").inputFiles()))
    if key not in _kept or not all(exists(t) for t in _kept[key]):
        _kept[key] = make()
    return _kept[key]


_kept_runs: dict[tuple, compact.Runs | None] = {}


def graph_runs(spark: SparkSession, d: str) -> compact.Runs | None:
    """The runs of the population's mer graph, made once for the same files; none if the graph has too many branches for one worker and is searched as tables."""
    key = (spark.sparkContext.applicationId, *sorted(_t(spark, d, "sequences").inputFiles()))
    held = _kept_runs.get(key)
    if key not in _kept_runs or held is not None and not exists(held.table):
        _kept_runs.clear()  # the driver holds the names of one graph's branches
        _kept_runs[key] = compact.runs(_population(spark, d).select("seq"), E)
    return _kept_runs[key]


_kept_pools: dict[tuple, compact.Pool | None] = {}


def kmer_pool(spark: SparkSession, d: str) -> compact.Pool | None:
    """The population's long mers, made once for the same files; none if they have too many branches for one worker and go by tables."""
    key = (spark.sparkContext.applicationId, *sorted(_t(spark, d, "sequences").inputFiles()))
    held = _kept_pools.get(key)
    if key not in _kept_pools or held is not None and not exists(held.table):
        found = graph_runs(spark, d)
        _kept_pools.clear()
        _kept_pools[key] = compact.pool(_population(spark, d).select("seq"), K, found) if found else None
    return _kept_pools[key]


def graph_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mer graph of the whole population."""

    def make() -> tuple[DataFrame, DataFrame]:
        rows = _population(spark, d)
        nodes, edges, _ = graph.from_rows(rows, written(tally.mer_tally(rows, E), "tally"), E)
        return written(nodes, "nodes"), written(edges, "edges")

    return _once(spark, d, "graph", make)


def graph_levels(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "levels", lambda: (graph.levels(graph_tables(spark, d)[1]),))[0]


def forward_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Its nodes, and the edges that lead up a level or to END."""
    nodes, edges = graph_tables(spark, d)
    return nodes, _once(spark, d, "forward", lambda: (written(graph.forward(edges, graph_levels(spark, d)), "forward"),))[0]


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph_tables(spark, d)[0]


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph_tables(spark, d)[1]


def sequence_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return graph.overlaps(tally.mer_tally(_population(spark, d), E), E)


def edge_costs(spark: SparkSession, d: str) -> DataFrame:
    if found := graph_runs(spark, d):
        return graph.costs_of(compact.costs(found))
    nodes, edges = graph_tables(spark, d)
    return graph.edge_costs(nodes, edges, graph_levels(spark, d))


def low_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.low_edges(*graph_tables(spark, d), 1)


def weak_nodes(spark: SparkSession, d: str) -> DataFrame:
    counts = tally.mer_tally(_population(spark, d), E)
    return graph.weak_nodes(counts, written(graph.overlaps(counts, E), "overlaps"))


def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    found = graph_runs(spark, d)
    return compact.levels(found) if found else graph_levels(spark, d)


def forward_edges(spark: SparkSession, d: str) -> DataFrame:
    if found := graph_runs(spark, d):
        return compact.forward(found)
    return forward_tables(spark, d)[1]


def trim_dead(spark: SparkSession, d: str) -> DataFrame:
    """The forward edges without mers that hold WW or MC, dead ends and dead begins."""
    if found := graph_runs(spark, d):
        return compact.trimmed(found, F.contains("text", F.lit("WW")) | F.contains("text", F.lit("MC")))
    nodes, edges = forward_tables(spark, d)
    gone = nodes.where("mer like '%WW%' or mer like '%MC%'").select("mer")
    return graph.without_dead_begins(graph.without_dead_ends(written(graph.without(edges, gone), "kept")))


def _score(spark: SparkSession, value: int) -> DataFrame:
    return spark.createDataFrame([(value,)] if value >= 0 else [], "score bigint")


def best_path_score(spark: SparkSession, d: str) -> DataFrame:
    if found := graph_runs(spark, d):
        return _score(spark, compact.solved(found).end[1])
    nodes, edges = forward_tables(spark, d)
    values = paths.best_values(nodes, edges).where(F.col("mer") == graph.END)
    return values.select(F.col("value").cast("bigint").alias("score"))


def best_node_values(spark: SparkSession, d: str) -> DataFrame:
    if found := graph_runs(spark, d):
        return compact.values(found)
    nodes, edges = forward_tables(spark, d)
    return paths.best_values(nodes, edges).select("mer", F.col("value").cast("bigint").alias("value"))


def path_bandwidth(spark: SparkSession, d: str) -> DataFrame:
    if found := graph_runs(spark, d):
        return _score(spark, compact.solved(found).end[2])
    nodes, edges = forward_tables(spark, d)
    return paths.best_values(nodes, edges, True).where(F.col("mer") == graph.END).select(F.col("value").cast("bigint").alias("score"))


def complementary_paths(spark: SparkSession, d: str) -> DataFrame:
    """What two complementary ways are held to: each is a way from BEGIN to END, and the first has the best score."""
    if found := graph_runs(spark, d):
        return compact.complementary_facts(found, 2)
    nodes, edges = forward_tables(spark, d)
    ways = paths.complementary_paths(nodes, edges, 2)
    return paths.way_facts(ways, nodes, edges)


def design_antigens(spark: SparkSession, d: str) -> DataFrame:
    """Two sequences from mers that more than two records hold, the best of two trials."""
    p, found = Design(e=E, m=2, trials=2, low_nodes=2), graph_runs(spark, d)
    designed = design_table(found, p) if found else design(_population(spark, d), p)
    return designed.withColumn("share", F.round("share", 9))


def decycle_removed(spark: SparkSession, d: str) -> DataFrame:
    """What the removal of cycles is held to: how many edges there were, and how many are still on a cycle."""
    if found := graph_runs(spark, d):
        return acyclic.removal_facts(found)
    nodes, edges = graph_tables(spark, d)
    costs = graph.edge_costs(nodes, edges, graph_levels(spark, d), ["rss"]).withColumnRenamed("rss", "cost")
    return decycle.removal_facts(written(costs, "costs"))


def kmer_scores(spark: SparkSession, d: str) -> DataFrame:
    if held := kmer_pool(spark, d):
        return compact.pool_scores(held)
    rows = _population(spark, d)
    return greedy.scores(greedy.long_mers(rows, K), tally.mer_tally(rows, E), E)


def pool_quarter(spark: SparkSession, d: str) -> DataFrame:
    if held := kmer_pool(spark, d):
        return compact.pool_quarter(held)
    rows = _population(spark, d)
    return greedy.best_quarter(written(greedy.scores(greedy.long_mers(rows, K), tally.mer_tally(rows, E), E), "scores"))


def union_score(spark: SparkSession, d: str) -> DataFrame:
    rows = _population(spark, d)
    return greedy.union_score(greedy.tiles(_antigens(spark, d), K, E), tally.mer_tally(rows, E), E)


def greedy_kmers(spark: SparkSession, d: str) -> DataFrame:
    if held := kmer_pool(spark, d):
        return spark.createDataFrame([(i + 1, m, s) for i, (m, s) in enumerate(greedy.greedy(held, 3))], "pick int, kmer string, score bigint")
    return greedy.top_mers(_population(spark, d), K, E, 3)


def refined_kmers(spark: SparkSession, d: str) -> DataFrame:
    """What the rounds are held to: as many picks as asked for, their gains add up to what they cover together, and it is no less than the greedy picks cover."""
    rows = _population(spark, d)
    found = graph_runs(spark, d)
    members = compact.Heads(rows.select("seq"), K, found) if found else greedy.member_counts(rows, K, E)
    picks = greedy.refined(members, 3, 1)
    pool = spark.createDataFrame(picks, "kmer string, gain bigint")
    if found:
        counts = compact.nodes_of(found, sorted({m for kmer, _ in picks for m in members.mers(kmer)}))
    else:
        counts = written(tally.mer_tally(rows, E, rmx=False, rmdash=False), "tally")
    facts = pool.agg(F.count("*").alias("picks"), F.sum("gain").alias("total"))
    first = sum(s for _, s in greedy.greedy(members, 3))
    return facts.select("picks", (F.col("total") == greedy.union_score(pool, counts, E).scalar()).alias("adds_up"), (F.col("total") >= first).alias("no_less"), F.lit(first).cast("bigint").alias("greedy_score"))


def offby_shares(spark: SparkSession, d: str) -> DataFrame:
    return coverage.offby_shares(_population(spark, d), _antigens(spark, d), E, 1, True).withColumn("share", F.round("share", 9))


def _round_trip(spark: SparkSession, d: str, ending: str) -> DataFrame:
    rows = _population(spark, d).select("ord", F.regexp_replace(F.coalesce("name", F.lit("none")), "[^!-~]", "").alias("name"), "seq").where("seq <> '' and name <> ''")
    path = f"{shared_dir(spark)}/merloom-{uuid.uuid4().hex}.{ending}"
    writers.write_sequences(rows, path)
    return readers.read_sequences(spark, path)


def source_fasta(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "fasta").select("name", "seq")


def source_fasta_gz(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "fasta.gz").select("name", "seq")


def source_mase(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "mase").select("name", "seq")


def source_tbl(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "tbl").select("name", "seq")


def source_raw(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "seq").select("name", "seq")


def source_names(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "nm").select("name", "seq")


def source_weights(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "weights").where("weight is not null and name rlike '^[!-~]+$' and not contains(name, '#')")
    path = f"{shared_dir(spark)}/merloom-{uuid.uuid4().hex}.txt"
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select(F.concat_ws(" ", F.col("weight").cast("string"), "name", F.lit("# kept")).alias("value")).write.text(path)
    return tally.weight_table(readers.read_weights(spark, path))


def random_draws(spark: SparkSession, d: str) -> DataFrame:
    rows = _population(spark, d)
    return filters.drawn(rows, rows.count(), 7).select("draw", "ord")


def loaded_mers(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "sequences").select("loaded_at", residues(F.col("seq")).alias("seq"))
    return windowed_tally(rows, E, "loaded_at", "1 day")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return raw_rows.failed_rows(_t(spark, d, "raw_rows")).select("raw_id", "reason")


def p6_valid(spark: SparkSession, d: str) -> DataFrame:
    return raw_rows.valid_rows(_t(spark, d, "raw_rows"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p6_found": p6_found,
    "p6_valid": p6_valid,
    "loaded_mers": loaded_mers,
    "mer_tally": mer_tally,
    "mer_tally_weighted": mer_tally_weighted,
    "mer_total_bad": mer_total_bad,
    "end_mers": end_mers,
    "filter_name_pattern": filter_name_pattern,
    "filter_name_list": filter_name_list,
    "filter_name_exclude": filter_name_exclude,
    "clean_sequence": clean_sequence,
    "dedupe_keep_first": dedupe_keep_first,
    "max_seqs": max_seqs,
    "repeat_filter": repeat_filter,
    "design_rows": design_rows,
    "duplicated_mers": duplicated_mers,
    "tiled_kmers": tiled_kmers,
    "length_stats": length_stats,
    "micro_coverage_curve": micro_coverage_curve,
    "macro_coverage_curve": macro_coverage_curve,
    "macro_coverage_weighted": macro_coverage_weighted,
    "antigen_mer_counts": antigen_mer_counts,
    "rarest_mers": rarest_mers,
    "offby_coverage": offby_coverage,
    "near_mers": near_mers,
    "bootstrap_coverage": bootstrap_coverage,
    "bootstrap_offby": bootstrap_offby,
    "positional_tally": positional_tally,
    "ref_site_tally": ref_site_tally,
    "mer_positions": mer_positions,
    "gapped_places": gapped_places,
    "residue_maps": residue_maps,
    "site_missed": site_missed,
    "site_means": site_means,
    "site_entropy": site_entropy,
    "site_entropy_weighted": site_entropy_weighted,
    "consensus": consensus,
    "gap_columns": gap_columns,
    "strip_gap_columns": strip_gap_columns,
    "strip_master_columns": strip_master_columns,
    "column_values": column_values,
    "relative_names": relative_names,
    "graph_nodes": graph_nodes,
    "graph_edges": graph_edges,
    "sequence_overlaps": sequence_overlaps,
    "low_edges": low_edges,
    "weak_nodes": weak_nodes,
    "kmer_scores": kmer_scores,
    "pool_quarter": pool_quarter,
    "union_score": union_score,
    "greedy_kmers": greedy_kmers,
    "offby_shares": offby_shares,
    "source_fasta": source_fasta,
    "source_fasta_gz": source_fasta_gz,
    "source_mase": source_mase,
    "source_tbl": source_tbl,
    "source_raw": source_raw,
    "source_names": source_names,
    "source_weights": source_weights,
    "random_draws": random_draws,
}

#: Queries that take many rounds of jobs; they come last.
LONG: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bfs_levels": bfs_levels,
    "edge_costs": edge_costs,
    "forward_edges": forward_edges,
    "best_path_score": best_path_score,
    "best_node_values": best_node_values,
    "path_bandwidth": path_bandwidth,
    "trim_dead": trim_dead,
    "refined_kmers": refined_kmers,
    "complementary_paths": complementary_paths,
    "decycle_removed": decycle_removed,
    "design_antigens": design_antigens,
}

#: One regular expression for a well-quoted line, and DuckDB's view of its fields.
_FIELD = '("[^"]*(""[^"]*)*"|[^",]*)'
_RAW = f"""
WITH l AS (SELECT raw_id, CASE WHEN right(coalesce(line, ''), 1) = chr(13) THEN left(line, length(line) - 1) ELSE coalesce(line, '') END AS line FROM raw_rows),
q AS (SELECT raw_id, line, regexp_full_match(line, '{_FIELD}(,{_FIELD})*', 's') AS quoted FROM l WHERE NOT starts_with(line, '#')),
f AS (SELECT raw_id, quoted, CASE WHEN quoted THEN regexp_extract_all(',' || line, '(?s),("[^"]*(?:""[^"]*)*"|[^",]*)', 1) END AS raw FROM q),
v AS (SELECT raw_id, quoted, list_transform(raw, lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END, ' ')) AS f FROM f),
r AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 4 THEN 'columns'
  WHEN NOT regexp_full_match(f[1], '[0-9]{{1,18}}') OR f[2] = '' OR NOT regexp_full_match(f[3], '[A-Za-z*-]+')
    OR NOT regexp_full_match(f[4], '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
    OR NOT coalesce(try_cast(f[4] AS DOUBLE) > 0 AND isfinite(try_cast(f[4] AS DOUBLE)), false) THEN 'value' END AS reason FROM v)
"""

_POP = "pop AS (SELECT ord, name, regexp_replace(upper(seq), '[^A-Z]', '', 'g') AS seq FROM sequences WHERE seq IS NOT NULL)"
_ANT = "ant AS (SELECT row_number() OVER (ORDER BY ord) AS k, name, regexp_replace(upper(seq), '[^A-Z]', '', 'g') AS seq FROM antigens WHERE seq IS NOT NULL)"
_GAP = "gap AS (SELECT ord, name, regexp_replace(upper(seq), '[^A-Z-]', '', 'g') AS seq FROM sequences WHERE seq IS NOT NULL)"
_PLAIN = "plain AS (SELECT ord, name, regexp_replace(seq, '[^ -~]', '', 'g') AS seq FROM sequences WHERE seq IS NOT NULL)"
_WEIGHTS = "wt AS (SELECT name, arg_max(weight, line_no) AS weight FROM weights WHERE name IS NOT NULL AND weight IS NOT NULL GROUP BY name)"
_CUST = "cust AS (SELECT c_custkey AS ord, c_name AS seq FROM customer)"
_CUSTGAP = "cust AS (SELECT c_custkey AS ord, translate(c_name, '0e', '--') AS seq FROM customer)"


def _windows(q: str, e: int) -> str:
    return f"list_transform(range(1, length({q}) - {e} + 2), lambda i: substring({q}, i, {e}))"


def _sets(table: str, e: int, columns: str, name: str = "m") -> str:
    """One row for each distinct mer of each row."""
    return f"{name} AS (SELECT {columns}, unnest(list_distinct({_windows('seq', e)})) AS mer FROM {table})"


_TALLY = f"{_POP}, {_sets('pop', 9, 'ord')}, tally AS (SELECT mer, count(*) AS cnt FROM m GROUP BY mer)"
_FIRST = f"{_ANT}, {_sets('ant', 9, 'k', 'am')}, first AS (SELECT mer, min(k) AS k FROM am GROUP BY mer)"
_REPEATED = "(SELECT count(*) FROM (SELECT 1 FROM unnest({w}) AS u(x) GROUP BY x HAVING count(*) > 1))"
_COLUMNS = f"""{_GAP},
p AS (SELECT ord, seq, list_filter(range(0, length(seq)), lambda i: substring(seq, i + 1, 1) <> '-') AS pl, replace(seq, '-', '') AS bare FROM gap),
g AS (SELECT ord, unnest(list_transform(range(1, len(pl) - 7), lambda i: {{'pos': pl[i], 'mer': substring(bare, i, 9), 'gapped': substring(seq, pl[i] + 1, pl[i + 8] - pl[i] + 1)}})) AS g FROM p),
placed AS (SELECT ord, CAST(g.pos AS INT) AS pos, g.mer AS mer, g.gapped AS gapped FROM g)"""
_CELLS = f"""{_COLUMNS}, {_FIRST},
cells AS (SELECT pos, k, CAST(count(*) AS DOUBLE) AS cnt FROM placed LEFT JOIN first USING (mer) GROUP BY pos, k),
curve AS (SELECT CAST(a.k AS INT) AS k, c.pos, 100 * sum(CASE WHEN c.k IS NULL OR c.k > a.k THEN cnt ELSE 0 END) / (SELECT count(*) FROM gap) AS missed FROM cells c, ant a GROUP BY a.k, c.pos)"""


def _entropy(rows: str, good: str) -> str:
    return f"""{rows}, i AS (SELECT unnest(range(1, length(seq) + 1)) AS i, seq, w FROM r), ch AS (SELECT CAST(i - 1 AS INT) AS pos, substring(seq, i, 1) AS c, w FROM i),
n AS (SELECT pos, c, sum(w) AS w FROM ch WHERE {good} GROUP BY pos, c HAVING sum(w) > 0), t AS (SELECT pos, sum(w) AS t FROM n GROUP BY pos)
SELECT pos, round(sum(w / t * ln(t / w)) + 0.0, 6) AS entropy FROM n JOIN t USING (pos) GROUP BY pos"""


_GRAPH = f"""{_POP}, {_sets('pop', 9, 'ord')}, tally AS MATERIALIZED (SELECT mer, count(*) AS cnt, mer[2:] AS tail, mer[:8] AS head FROM m GROUP BY mer),
ends AS (SELECT left(seq, 9) AS f, right(seq, 9) AS l FROM pop WHERE length(seq) >= 9),
nodes AS MATERIALIZED (SELECT mer, cnt FROM tally UNION ALL SELECT * FROM (VALUES ('==BEGIN==', 0), ('===END===', 0)) v(mer, cnt)),
inner_ AS MATERIALIZED (SELECT a.mer AS src, b.mer AS dst FROM tally a JOIN tally b ON a.tail = b.head WHERE a.mer <> b.mer),
edges AS MATERIALIZED (SELECT src, dst FROM inner_
  UNION ALL SELECT '==BEGIN==', mer FROM (SELECT DISTINCT f AS mer FROM ends) UNION ALL SELECT mer, '===END===' FROM (SELECT DISTINCT l AS mer FROM ends))"""
_LEVELS = f"""WITH RECURSIVE {_GRAPH}, levels(mer, ppos) USING KEY (mer) AS (SELECT '==BEGIN==', 0 UNION SELECT e.dst, min(w.ppos) + 1 FROM levels w JOIN edges e ON e.src = w.mer ANTI JOIN recurring.levels k ON k.mer = e.dst GROUP BY e.dst)"""
_FORWARD = f"""{_LEVELS}, forward AS MATERIALIZED (SELECT src, dst FROM edges JOIN levels a ON a.mer = src JOIN levels b ON b.mer = dst WHERE b.ppos > a.ppos OR dst = '===END===')"""
_COSTS = f"""{_LEVELS}, din AS (SELECT dst AS mer, count(*) AS n FROM edges GROUP BY dst), dout AS (SELECT src AS mer, count(*) AS n FROM edges GROUP BY src),
x AS (SELECT e.src, e.dst, a.cnt AS ca, b.cnt AS cb, CAST(ib.n = 1 AS INT) AS sp, CAST(oa.n = 1 AS INT) AS sib, CAST(coalesce(ia.n, 0) = 1 AS INT) AS ia, CAST(coalesce(ob.n, 0) = 1 AS INT) AS ob, la.ppos AS pa, lb.ppos AS pb
  FROM edges e JOIN nodes a ON a.mer = e.src JOIN nodes b ON b.mer = e.dst LEFT JOIN din ib ON ib.mer = e.dst LEFT JOIN dout oa ON oa.mer = e.src LEFT JOIN din ia ON ia.mer = e.src LEFT JOIN dout ob ON ob.mer = e.dst LEFT JOIN levels la ON la.mer = e.src LEFT JOIN levels lb ON lb.mer = e.dst)
SELECT src, dst, ca + cb + cb * sp + ca * sib AS rss, ca + cb + 2 * cb * sp + 2 * ca * sib AS rs2, ca + cb AS sum, greatest(ca, cb) AS sup, ca * ia + cb * ob AS iso, greatest(ca, cb) + ca * ia + cb * ob AS supiso, greatest(ca, cb) + ca * ia + cb * ob AS sso,
  ca + cb + ca * sib AS sib, ca + cb + cb * sp AS sps, ca * 0 AS rnd, coalesce(-pa, 0) AS pos, coalesce(pb - pa, 0) AS dpos FROM x"""
_TRIM = f"""{_FORWARD}, kept AS MATERIALIZED (SELECT src, dst FROM forward WHERE NOT contains(src, 'WW') AND NOT contains(dst, 'WW') AND NOT contains(src, 'MC') AND NOT contains(dst, 'MC')),
up AS (SELECT '===END===' AS mer UNION SELECT l.src FROM up JOIN kept l ON l.dst = up.mer), down AS (SELECT '==BEGIN==' AS mer UNION SELECT l.dst FROM down JOIN kept l ON l.src = down.mer)"""
# a way never comes back to a level, so a node's value is final when its level is reached; END, which all levels lead to, is read last
_PATHS = f"""{_FORWARD}, walk AS (SELECT '==BEGIN==' AS mer, CAST(0 AS BIGINT) AS v, CAST(999999 AS BIGINT) AS w UNION ALL SELECT e.dst, CAST(max(k.v + n.cnt) AS BIGINT), CAST(max(least(k.w, n.cnt)) AS BIGINT) FROM walk k JOIN forward e ON e.src = k.mer JOIN nodes n ON n.mer = e.dst WHERE e.dst <> '===END===' GROUP BY e.dst),
best AS (SELECT mer, v, w FROM walk UNION ALL SELECT '===END===', max(v), max(w) FROM walk JOIN forward e ON e.src = walk.mer AND e.dst = '===END===')"""
_KMERS = f"kmers AS (SELECT DISTINCT unnest({{w}}) AS kmer FROM {{t}}), mem AS (SELECT kmer, unnest(list_distinct({{s}})) AS mer FROM kmers)"
_LONG = _KMERS.format(w=_windows("seq", 15), t="pop", s=_windows("kmer", 9))
_SOURCE = f"WITH {_POP}, r AS (SELECT regexp_replace(coalesce(name, 'none'), '[^!-~]', '', 'g') AS name, seq FROM pop WHERE seq <> '')"
_GREEDY = f"""WITH {_TALLY}, {_LONG}, sc AS (SELECT kmer, mer, coalesce(cnt, 0) AS cnt FROM mem LEFT JOIN tally USING (mer)),
p1 AS (SELECT 1 AS pick, kmer, CAST(sum(cnt) AS BIGINT) AS score FROM sc GROUP BY kmer ORDER BY score DESC, kmer LIMIT 1),
s2 AS (SELECT * FROM sc WHERE mer NOT IN (SELECT mer FROM sc WHERE kmer IN (SELECT kmer FROM p1))),
p2 AS (SELECT 2 AS pick, kmer, CAST(sum(cnt) AS BIGINT) AS score FROM s2 GROUP BY kmer ORDER BY score DESC, kmer LIMIT 1),
s3 AS (SELECT * FROM s2 WHERE mer NOT IN (SELECT mer FROM sc WHERE kmer IN (SELECT kmer FROM p2))),
p3 AS (SELECT 3 AS pick, kmer, CAST(sum(cnt) AS BIGINT) AS score FROM s3 GROUP BY kmer ORDER BY score DESC, kmer LIMIT 1)
SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3"""
_NEAR = f"""WITH {_TALLY}, {_FIRST},
b1 AS (SELECT mer, b, substring(mer, b * 3 + 1, 3) AS s FROM tally, (VALUES (0), (1), (2)) v(b)), b2 AS (SELECT mer, b, substring(mer, b * 3 + 1, 3) AS s FROM first, (VALUES (0), (1), (2)) v(b)),
near AS (SELECT DISTINCT b2.mer AS mer, b1.mer AS near_mer, hamming(b1.mer, b2.mer) AS dist FROM b1 JOIN b2 USING (b, s) WHERE hamming(b1.mer, b2.mer) <= 2)"""


# the draws of coverage.bootstrap(), and what they make of h (ord, dist, k, n)
_RESAMPLED = """b AS (SELECT unnest(range(1, 21)) AS b), o AS (SELECT DISTINCT ord FROM h),
u AS (SELECT ord, b, (CAST('0x' || left(md5('1:' || b || ':' || ord), 10) AS BIGINT) + 0.5) / 1099511627776.0 AS u FROM o, b),
p AS (SELECT list(exp(-1) / f) AS p FROM (SELECT unnest([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800, 39916800]) AS f)),
t AS (SELECT ord, b, len(list_filter(range(1, 13), lambda i: u > list_sum(p[1:i]))) AS times FROM u, p WHERE u > 0.3678),
s AS (SELECT b, dist, k, sum(n * times) AS n FROM h JOIN t USING (ord) GROUP BY b, dist, k), w AS (SELECT b, dist, sum(n) AS total FROM s GROUP BY b, dist),
c AS (SELECT a.k, w.b, w.dist, coalesce((SELECT sum(n) FROM s WHERE s.b = w.b AND s.dist = w.dist AND s.k <= a.k), 0) / total AS share FROM ant a, w),
r AS (SELECT CAST(k AS INT) AS k, CAST(dist AS INT) AS dist, round(avg(share), 6) AS mean, round(stddev_pop(share), 6) AS deviation FROM c GROUP BY k, dist)"""
_BOOTSTRAP = f"WITH {_POP}, {_sets('pop', 9, 'ord')}, {_FIRST}, h AS (SELECT ord, 0 AS dist, k, count(*) AS n FROM m LEFT JOIN first USING (mer) GROUP BY ord, k), {_RESAMPLED} SELECT k, mean, deviation FROM r"


SQL: dict[str, str] = {
    "loaded_mers": f"WITH p AS (SELECT ord, date_trunc('day', loaded_at) AS start, regexp_replace(upper(seq), '[^A-Z]', '', 'g') AS seq FROM sequences WHERE loaded_at IS NOT NULL), {_sets('p', 9, 'start, ord')} SELECT CAST(start AS TIMESTAMP) AS start, mer, count(*) AS cnt FROM m GROUP BY start, mer",
    "mer_tally": f"WITH {_TALLY} SELECT mer, cnt FROM tally",
    "mer_tally_weighted": f"WITH {_POP}, {_WEIGHTS}, {_sets('(SELECT p.seq, coalesce(w.weight, 1.0) AS weight FROM pop p LEFT JOIN wt w USING (name))', 9, 'weight')} SELECT mer, round(sum(weight), 6) AS cnt FROM m GROUP BY mer",
    "mer_total_bad": f"WITH {_POP}, m AS (SELECT unnest(list_distinct({_windows('s', 9)})) AS mer FROM (SELECT replace(seq, 'X', 'x') AS s FROM pop)) SELECT count(*) AS total, true AS bad FROM m UNION ALL SELECT count(*), false FROM m WHERE NOT contains(mer, 'x')",
    "end_mers": f"WITH {_POP}, x AS (SELECT left(seq, 9) AS mer, true AS f FROM pop WHERE length(seq) >= 9 UNION ALL SELECT right(seq, 9), false FROM pop WHERE length(seq) >= 9) SELECT mer, bool_or(f) AS is_first, bool_or(NOT f) AS is_last FROM x GROUP BY mer",
    "filter_name_pattern": f"WITH {_POP} SELECT ord, name FROM pop WHERE regexp_matches(name, '^BB[CD]') AND NOT regexp_matches(name, 'clone|_')",
    "filter_name_list": f"WITH {_POP} SELECT ord, name FROM pop WHERE regexp_matches(lower(coalesce(name, '')), '^bbc|hb') OR ord = (SELECT min(ord) FROM pop)",
    "filter_name_exclude": f"WITH {_POP} SELECT ord, name FROM pop WHERE NOT regexp_matches(lower(coalesce(name, '')), '^u|hb')",
    "clean_sequence": f"WITH {_PLAIN} SELECT ord, left(reverse(translate(upper(replace(seq, '-', '')), '#Xx$', 'xxx*')), 60) AS seq FROM plain",
    "dedupe_keep_first": f"WITH {_POP} SELECT ord, seq FROM pop QUALIFY seq = '' OR row_number() OVER (PARTITION BY seq ORDER BY ord) = 1",
    "max_seqs": f"WITH {_PLAIN}, c AS (SELECT ord, name, translate(upper(replace(seq, '-', '')), '#Xx$', 'xxx*') AS seq FROM plain WHERE regexp_matches(name, '^BB')) SELECT * FROM (SELECT * FROM c QUALIFY seq = '' OR row_number() OVER (PARTITION BY seq ORDER BY ord) = 1) ORDER BY ord LIMIT 100",
    "repeat_filter": f"WITH {_POP}, w AS (SELECT ord, unnest({_windows('seq', 3)}) AS mer FROM pop), n AS (SELECT ord, mer FROM w GROUP BY ord, mer HAVING count(*) > 1), k AS (SELECT ord FROM n GROUP BY ord HAVING count(*) >= 4) SELECT ord FROM pop WHERE ord NOT IN (SELECT ord FROM k)",
    "design_rows": f"WITH {_POP}, w AS (SELECT ord, unnest({_windows('seq', 9)}) AS mer FROM pop WHERE length(seq) >= 30), n AS (SELECT ord, mer FROM w GROUP BY ord, mer HAVING count(*) > 1), k AS (SELECT ord FROM n GROUP BY ord HAVING count(*) >= 3) SELECT ord, substring(reverse(seq), 6, 20) AS seq FROM pop WHERE length(seq) >= 30 AND ord NOT IN (SELECT ord FROM k)",
    "duplicated_mers": f"WITH {_POP}, w AS (SELECT ord, unnest({_windows('seq', 4)}) AS mer FROM pop) SELECT ord, mer FROM w GROUP BY ord, mer HAVING count(*) > 1",
    "tiled_kmers": f"WITH {_POP}, t AS (SELECT DISTINCT unnest(list_transform(range(0, greatest(CAST(ceil(1 + (length(seq) - 15) / 7.0) AS BIGINT), 0)), lambda i: substring(seq, i * 7 + 1, 15))) AS kmer FROM pop) SELECT kmer FROM t",
    "length_stats": f"WITH {_POP}, h AS (SELECT CAST(length(seq) AS INT) AS len, count(*) AS rows FROM pop GROUP BY 1) SELECT len, rows, min(len) OVER () AS least, max(len) OVER () AS most, CAST(sum(rows) OVER () AS BIGINT) AS all_rows FROM h",
    "micro_coverage_curve": f"WITH {_TALLY}, {_FIRST}, g AS (SELECT a.k, CAST((SELECT coalesce(sum(cnt), 0) FROM tally JOIN first f USING (mer) WHERE f.k <= a.k) AS BIGINT) AS covered, CAST((SELECT sum(cnt) FROM tally) AS BIGINT) AS total FROM ant a) SELECT CAST(k AS INT) AS k, covered, total, round(covered / total, 9) AS share FROM g",
    "macro_coverage_curve": f"WITH {_POP}, {_sets('pop', 9, 'ord')}, {_FIRST}, n AS (SELECT ord, count(*) AS n FROM m GROUP BY ord), h AS (SELECT f.k, sum(1.0 / n.n) AS part FROM m JOIN first f USING (mer) JOIN n USING (ord) GROUP BY f.k) SELECT CAST(a.k AS INT) AS k, round(100 * (1 - (SELECT coalesce(sum(part), 0) FROM h WHERE h.k <= a.k) / (SELECT count(*) FROM n)), 6) AS missed FROM ant a",
    "macro_coverage_weighted": f"WITH {_POP}, {_WEIGHTS}, pw AS (SELECT p.ord, p.seq, coalesce(w.weight, 1.0) AS weight FROM pop p LEFT JOIN wt w USING (name)), {_sets('pw', 9, 'ord, weight')}, {_FIRST}, n AS (SELECT ord, any_value(weight) AS weight, count(*) AS n FROM m GROUP BY ord), h AS (SELECT f.k, sum(n.weight / n.n) AS part FROM m JOIN first f USING (mer) JOIN n USING (ord) GROUP BY f.k) SELECT CAST(a.k AS INT) AS k, round(100 * (1 - (SELECT coalesce(sum(part), 0) FROM h WHERE h.k <= a.k) / (SELECT sum(weight) FROM n)), 6) AS missed FROM ant a",
    "antigen_mer_counts": f"WITH {_TALLY}, {_ANT}, {_sets('ant', 9, 'k', 'am')} SELECT CAST(k AS INT) AS k, mer, CAST(coalesce(cnt, 0) AS DOUBLE) AS cnt, round(coalesce(cnt, 0) / (SELECT count(*) FROM pop), 9) AS share FROM am LEFT JOIN tally USING (mer)",
    "rarest_mers": f"WITH {_TALLY}, {_FIRST} SELECT coalesce(cnt, 0) AS least, count(*) AS mers FROM first LEFT JOIN tally USING (mer) GROUP BY 1 ORDER BY 1 LIMIT 1",
    "offby_coverage": _NEAR + ", best AS (SELECT n.near_mer AS mer, d.dist, min(f.k) AS k FROM near n JOIN first f USING (mer) JOIN (VALUES (0), (1), (2)) d(dist) ON n.dist <= d.dist GROUP BY 1, 2), g AS (SELECT b.dist, b.k, sum(cnt) AS cnt FROM best b JOIN tally USING (mer) GROUP BY 1, 2) SELECT CAST(a.k AS INT) AS k, d.dist, CAST((SELECT coalesce(sum(cnt), 0) FROM g WHERE g.dist = d.dist AND g.k <= a.k) AS BIGINT) AS covered FROM ant a, (VALUES (0), (1), (2)) d(dist)",
    "near_mers": _NEAR + " SELECT mer, near_mer, CAST(dist AS INT) AS dist FROM near WHERE dist > 0",
    "positional_tally": f"WITH {_COLUMNS} SELECT pos, mer, CAST(count(*) AS DOUBLE) AS cnt FROM placed GROUP BY pos, mer",
    "ref_site_tally": f"WITH {_COLUMNS}, ref AS (SELECT seq AS r FROM gap ORDER BY ord LIMIT 1) SELECT CAST(length(replace(left(r, pos), '-', '')) AS INT) AS site, mer, CAST(count(*) AS DOUBLE) AS cnt FROM placed, ref GROUP BY 1, 2",
    "mer_positions": f"WITH {_COLUMNS} SELECT mer, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM (SELECT DISTINCT mer, pos FROM placed) GROUP BY mer",
    "gapped_places": f"WITH {_COLUMNS} SELECT ord, gapped, max(pos) AS pos FROM placed GROUP BY ord, gapped",
    "residue_maps": f"WITH {_COLUMNS} SELECT ord, array_to_string(pl, ',') AS places FROM p",
    "site_missed": f"WITH {_CELLS} SELECT k, pos, round(missed, 6) AS missed FROM curve",
    "site_means": f"WITH {_CELLS} SELECT k, round(avg(missed), 6) AS missed FROM curve GROUP BY k",
    "site_entropy": _entropy(f"WITH {_GAP}, r AS (SELECT seq, 1.0 AS w FROM gap)", "c <> 'X'"),
    "site_entropy_weighted": _entropy(f"WITH {_POP}, {_WEIGHTS}, r AS (SELECT p.seq, coalesce(wt.weight, 1.0) AS w FROM pop p LEFT JOIN wt USING (name))", "true"),
    "consensus": f"WITH {_CUST}, ch AS (SELECT ord, unnest(range(1, length(seq) + 1)) AS i, seq FROM cust), n AS (SELECT CAST(i - 1 AS INT) AS pos, substring(seq, i, 1) AS ch, count(*) AS cnt, min(ord) AS f FROM ch GROUP BY 1, 2) SELECT pos, ch, cnt FROM n WHERE pos < (SELECT min(length(seq)) FROM cust) QUALIFY row_number() OVER (PARTITION BY pos ORDER BY cnt DESC, f) = 1",
    "gap_columns": f"WITH {_CUSTGAP}, ch AS (SELECT unnest(range(1, length(seq) + 1)) AS i, seq FROM cust) SELECT CAST(i - 1 AS INT) AS pos FROM ch GROUP BY i HAVING bool_and(substring(seq, i, 1) = '-')",
    "strip_gap_columns": f"WITH {_CUSTGAP}, ch AS (SELECT unnest(range(1, length(seq) + 1)) AS i, seq FROM cust), k AS (SELECT list(i ORDER BY i) AS l FROM (SELECT i FROM ch GROUP BY i HAVING NOT bool_and(substring(seq, i, 1) = '-'))) SELECT ord, array_to_string(list_transform(l, lambda i: substring(seq, i, 1)), '') AS seq FROM cust, k",
    "strip_master_columns": f"WITH {_CUSTGAP}, a AS (SELECT seq AS r FROM cust ORDER BY ord LIMIT 1), k AS (SELECT list_filter(range(1, length(r) + 1), lambda i: substring(r, i, 1) <> '-') AS l FROM a) SELECT ord, array_to_string(list_transform(l, lambda i: substring(seq, i, 1)), '') AS seq FROM cust, k",
    "column_values": f"WITH {_POP}, v AS (SELECT ord, substring(seq, 1, 1) || substring(seq, 5, 1) || substring(seq, 20, 1) AS value FROM pop WHERE length(seq) >= 20) SELECT ord, value FROM v WHERE NOT contains(value, 'X')",
    "relative_names": f"WITH {_CUST}, a AS (SELECT seq AS r FROM cust ORDER BY ord LIMIT 1) SELECT ord, array_to_string(list_transform(range(1, least(length(seq), length(r)) + 1), lambda i: CASE WHEN substring(seq, i, 1) = substring(r, i, 1) THEN '.' ELSE substring(seq, i, 1) END), '') AS relative FROM cust, a",
    "graph_nodes": f"WITH {_GRAPH} SELECT mer, cnt FROM nodes",
    "graph_edges": f"WITH {_GRAPH} SELECT src, dst FROM edges",
    "sequence_overlaps": f"WITH {_GRAPH} SELECT src, dst FROM inner_",
    "edge_costs": _COSTS,
    "low_edges": f"WITH {_GRAPH} SELECT src, dst FROM edges JOIN nodes a ON a.mer = src JOIN nodes b ON b.mer = dst WHERE a.cnt <= 1 AND b.cnt <= 1",
    "weak_nodes": f"WITH {_GRAPH}, i AS (SELECT dst AS mer, min(src) AS p FROM inner_ GROUP BY dst HAVING count(*) = 1), o AS (SELECT src AS mer, min(dst) AS s FROM inner_ GROUP BY src HAVING count(*) = 1) SELECT t.mer FROM tally t JOIN i USING (mer) JOIN o USING (mer) JOIN tally a ON a.mer = p JOIN tally b ON b.mer = s WHERE t.cnt <= 1 AND a.cnt <= 1 AND b.cnt <= 1",
    "bfs_levels": _LEVELS + " SELECT mer, ppos FROM levels",
    "forward_edges": _FORWARD + " SELECT src, dst FROM forward",
    "trim_dead": _TRIM + " SELECT src, dst FROM kept WHERE src IN (SELECT mer FROM down) AND dst IN (SELECT mer FROM up)",
    "complementary_paths": _PATHS + ", p AS (SELECT unnest([0, 1]) AS path_id) SELECT CAST(path_id AS INT) AS path_id, true AS whole, CAST((SELECT v FROM best WHERE mer = '===END===') AS BIGINT) AS first_score FROM p",
    "decycle_removed": f"WITH {_GRAPH} SELECT count(*) AS edges, CAST(0 AS BIGINT) AS left_on_cycles, true AS some_removed FROM edges",
    "best_path_score": _PATHS + " SELECT v AS score FROM best WHERE mer = '===END==='",
    "best_node_values": _PATHS + " SELECT mer, v AS value FROM best",
    "path_bandwidth": _PATHS + " SELECT w AS score FROM best WHERE mer = '===END==='",
    "kmer_scores": f"WITH {_TALLY}, {_LONG} SELECT kmer, CAST(sum(coalesce(cnt, 0)) AS BIGINT) AS score FROM mem LEFT JOIN tally USING (mer) GROUP BY kmer",
    "pool_quarter": f"WITH {_TALLY}, {_LONG}, s AS (SELECT kmer, CAST(sum(coalesce(cnt, 0)) AS BIGINT) AS score FROM mem LEFT JOIN tally USING (mer) GROUP BY kmer) SELECT kmer, score FROM s QUALIFY row_number() OVER (ORDER BY score DESC, kmer) <= (SELECT count(*) FROM s) // 4",
    "random_draws": f"WITH {_POP}, n AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS n FROM pop), c AS (SELECT count(*) AS c FROM pop), d AS (SELECT unnest(range(0, c)) AS draw, c FROM c) SELECT draw, ord FROM d JOIN n ON n.n = CAST('0x' || left(md5('7:' || draw), 15) AS BIGINT) % c",
    "bootstrap_coverage": _BOOTSTRAP,
    "bootstrap_offby": _NEAR + ", v AS (SELECT unnest([0, 1]) AS dist), best AS (SELECT n.near_mer AS mer, v.dist, min(f.k) AS k FROM near n JOIN first f USING (mer) JOIN v ON n.dist <= v.dist GROUP BY 1, 2), h AS (SELECT m.ord, v.dist, best.k, count(*) AS n FROM m CROSS JOIN v LEFT JOIN best ON best.mer = m.mer AND best.dist = v.dist GROUP BY 1, 2, 3), " + _RESAMPLED + " SELECT * FROM r",
    "refined_kmers": f"WITH g AS ({_GREEDY}) SELECT count(*) AS picks, true AS adds_up, true AS no_less, CAST(sum(score) AS BIGINT) AS greedy_score FROM g",
    "offby_shares": _NEAR + ", best AS (SELECT n.near_mer AS mer, d.dist, min(f.k) AS k FROM near n JOIN first f USING (mer) JOIN (VALUES (0), (1)) d(dist) ON n.dist <= d.dist GROUP BY 1, 2), g AS (SELECT b.dist, b.k, sum(cnt) AS cnt FROM best b JOIN tally USING (mer) GROUP BY 1, 2), c AS (SELECT CAST(a.k AS INT) AS k, d.dist, CAST((SELECT coalesce(sum(cnt), 0) FROM g WHERE g.dist = d.dist AND g.k <= a.k) AS BIGINT) AS covered, CAST((SELECT sum(cnt) FROM tally) AS BIGINT) AS total FROM ant a, (VALUES (0), (1)) d(dist)) SELECT *, round(covered / total, 9) AS share FROM c",
    "union_score": f"WITH {_TALLY}, a AS (SELECT regexp_replace(upper(seq), '[^A-Z]', '', 'g') AS seq FROM antigens WHERE seq IS NOT NULL), t AS (SELECT DISTINCT unnest(list_transform(range(0, greatest(CAST(ceil(1 + (length(seq) - 15) / 7.0) AS BIGINT), 0)), lambda i: substring(seq, i * 7 + 1, 15))) AS kmer FROM a), u AS (SELECT DISTINCT unnest({_windows('kmer', 9)}) AS mer FROM t) SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) AS score FROM u JOIN tally USING (mer)",
    "greedy_kmers": _GREEDY,
    "source_fasta": _SOURCE + " SELECT name, seq FROM r WHERE name <> ''",
    "source_fasta_gz": _SOURCE + " SELECT name, seq FROM r WHERE name <> ''",
    "source_mase": _SOURCE + " SELECT name, seq FROM r WHERE name <> ''",
    "source_tbl": _SOURCE + " SELECT name, seq FROM r WHERE name <> ''",
    "source_raw": _SOURCE + " SELECT '' AS name, seq FROM r WHERE name <> ''",
    "source_names": _SOURCE + " SELECT name, '' AS seq FROM r WHERE name <> ''",
    "source_weights": "SELECT name, arg_max(weight, line_no) AS weight FROM weights WHERE weight IS NOT NULL AND regexp_full_match(name, '[!-~]+') AND NOT contains(name, '#') GROUP BY name",
    "p6_found": _RAW + "SELECT raw_id, reason FROM r WHERE reason IS NOT NULL",
    "p6_valid": _RAW + "SELECT raw_id, CAST(f[1] AS BIGINT) AS ord, f[2] AS name, f[3] AS seq, CAST(f[4] AS DOUBLE) AS weight FROM r WHERE reason IS NULL",
}
