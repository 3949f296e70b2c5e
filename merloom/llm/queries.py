"""The queries of the problems, over the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merloom.llm import format_dup, language, leaders, near_dup, packing, spans, terms, tokens, varied
from merloom.storage import spread, written


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = near_dup.near_duplicates(_t(spark, d, "sequences"))
    pairs = near_dup.similar_rows(links, members)
    return pairs.select(F.col("id_a").alias("ord_a"), F.col("id_b").alias("ord_b"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.class_links(*near_dup.near_duplicates(_t(spark, d, "sequences"))).select(F.col("id_a").alias("ord_a"), F.col("id_b").alias("ord_b"), F.round("similarity", 6).alias("similarity"))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.class_members(*near_dup.near_duplicates(_t(spark, d, "sequences"))).select(F.col("id").alias("ord"), F.col("first").alias("class_ord"), "copies", "links")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return format_dup.format_copies(_t(spark, d, "sequences")).select(F.col("keep").alias("keep_ord"), F.col("copy").alias("copy_ord"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = format_dup.canonical(_t(spark, d, "sequences"))
    return format_dup.format_groups(rows).select(F.col("keep").alias("keep_ord"), "copies")


def p3_order(spark: SparkSession, d: str) -> DataFrame:
    return varied.varied_order(_t(spark, d, "sequences"), whole=True).withColumnRenamed("id", "ord")


def p3_subsets(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.read.parquet(f"{d}/size_requests.parquet").where("purpose = 'subset'")
    return varied.varied_subsets(_t(spark, d, "sequences"), wanted, whole=True).withColumnRenamed("id", "ord")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_counts(_t(spark, d, "sequences")).where("mark is not null").select("mer", "mark")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_counts(_t(spark, d, "sequences"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_t(spark, d, "sequences")).withColumnRenamed("id", "ord")


def p5_parts(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_parts(_t(spark, d, "sequences")).withColumnRenamed("id", "ord").withColumn("share", F.round("share", 6))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaders.heavy_values(spark.read.parquet(f"{d}/mer_tally.parquet"), share=0.002).select(F.col("value").alias("mer"))


def p7_top(spark: SparkSession, d: str) -> DataFrame:
    return leaders.heavy_values(spark.read.parquet(f"{d}/mer_tally.parquet"), k=100).select(F.col("value").alias("mer"), "total")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(_t(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """The round trip: what the ids stand for."""
    return tokens.texts_of(tokens.token_ids(_t(spark, d, "documents"))).withColumnRenamed("id", "doc_id")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.read.parquet(f"{d}/size_requests.parquet").where("purpose = 'container'")
    return packing.containers(_t(spark, d, "documents"), wanted).withColumnRenamed("id", "doc_id")


def p9_facts(spark: SparkSession, d: str) -> DataFrame:
    """What the containers are held to."""
    wanted = spark.read.parquet(f"{d}/size_requests.parquet").where("purpose = 'container'")
    return packing.packing_facts(written(packing.containers(_t(spark, d, "documents"), wanted), "placed"), wanted)


_networks: dict[tuple, language.Network] = {}


def _network(spark: SparkSession, d: str) -> tuple[DataFrame, language.Network]:
    """The documents and the network trained on them; trained once for the same files in one application."""
    documents, samples = _t(spark, d, "documents"), spark.read.parquet(f"{d}/lang_samples.parquet")
    key = (spark.sparkContext.applicationId, *sorted(documents.inputFiles()), *sorted(samples.inputFiles()), documents.count())
    if key not in _networks:
        _networks.clear()
        _networks[key] = language.fitted(documents, samples)
    return documents, _networks[key]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.label_errors(*_network(spark, d)).withColumnRenamed("id", "doc_id")


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(*_network(spark, d)).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_links": p1_links,
    "p1_members": p1_members,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_order": p3_order,
    "p3_subsets": p3_subsets,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p5_parts": p5_parts,
    "p7_found": p7_found,
    "p7_top": p7_top,
    "p8_ids": p8_ids,
    "p8_texts": p8_texts,
    "p9_containers": p9_containers,
    "p9_facts": p9_facts,
    "p10_found": p10_found,
    "p10_languages": p10_languages,
}

_RES = "regexp_replace(upper(seq), '[^A-Z]', '', 'g')"
_FORMS = f"""
WITH c AS (SELECT ord, list_sort(list_filter(list_transform(regexp_split_to_array(upper(seq), '[|;/]'), lambda x: regexp_replace(x, '[^A-Z]', '', 'g')), lambda x: x <> '')) AS chains
  FROM sequences WHERE length({_RES}) >= 20),
g AS (SELECT chains, min(ord) AS keep_ord, count(*) AS copies FROM c GROUP BY chains)
"""
_TERMS = f"""
WITH r AS (SELECT ord, {_RES} AS s FROM sequences),
w AS (SELECT ord, unnest(list_transform(range(1, length(s) - 2), lambda i: substring(s, i, 4))) AS mer FROM r WHERE length(s) >= 4),
m AS (SELECT mer, ord, count(*) AS n FROM w GROUP BY mer, ord),
t AS (SELECT mer, CAST(sum(n) AS BIGINT) AS count, count(*) AS records FROM m GROUP BY mer),
k AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records >= 0.05 * (SELECT count(*) FROM r WHERE length(s) >= 4) THEN 'common' END AS mark FROM t)
"""
_SPANS = f"""
WITH r AS (SELECT ord, {_RES} AS s FROM sequences),
w AS (SELECT ord, unnest(range(1, length(s) - 23)) AS i, unnest(list_transform(range(1, length(s) - 23), lambda i: substring(s, i, 25))) AS win FROM r WHERE length(s) >= 25),
k AS (SELECT win FROM w GROUP BY win HAVING min(ord) <> max(ord)),
h AS (SELECT ord, i, lag(i) OVER (PARTITION BY ord ORDER BY i) AS p FROM w SEMI JOIN k USING (win)),
g AS (SELECT ord, i, sum(CASE WHEN p IS NULL OR i > p + 25 THEN 1 ELSE 0 END) OVER (PARTITION BY ord ORDER BY i) AS part FROM h),
f AS (SELECT ord, min(i) AS span_start, max(i) + 25 - min(i) AS span_len FROM g GROUP BY ord, part)
"""
# the same bins and orders as in varied.py, for at least 20 residues
_VARIED = f"""
WITH r AS (SELECT ord, upper(trim(name, ' ')) AS n, coalesce({_RES}, '') AS s FROM sequences WHERE ord IS NOT NULL),
c AS (SELECT ord, s, CASE WHEN contains(n, '|') THEN trim(split_part(n, '|', 2), ' ') WHEN regexp_matches(n, '[._]') THEN regexp_extract(n, '^[^._]*') END AS code FROM r),
d AS (SELECT ord, s, length(s) >= 20 AS full_, CASE WHEN regexp_full_match(code, '[A-Z][A-Z0-9]{{0,7}}') THEN code ELSE '' END AS clade FROM c),
b AS (SELECT ord, s, clade, CASE WHEN full_ THEN CAST('0x' || left(md5(clade), 8) AS BIGINT) % {varied.CLADE_BINS} ELSE -1 END AS b0,
  CASE WHEN full_ THEN len(list_filter({varied.length_steps(20)}, lambda x: length(s) >= x)) ELSE -1 END AS b1,
  CASE WHEN full_ THEN least(floor((1 - length(translate(s, 'AVILMFWYC', '')) / greatest(length(s), 1)) * 2 * 4), 3)::INT ELSE -1 END AS b2,
  CASE WHEN full_ THEN least(floor((1 - length(translate(s, 'DEKRH', '')) / greatest(length(s), 1)) * 2 * 4), 3)::INT ELSE -1 END AS b3 FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ord) AS copy FROM b),
k AS (SELECT b0, b1, b2, b3, row_number() OVER (PARTITION BY b0 ORDER BY count(*) DESC, md5(concat_ws(':', b0, b1, b2, b3))) AS turn FROM p GROUP BY b0, b1, b2, b3),
m AS (SELECT b0, b1, b2, b3, row_number() OVER (ORDER BY turn, md5(CAST(b0 AS VARCHAR))) AS cell_no FROM k),
o AS (SELECT ord, clade, CAST(cell_no AS INT) AS cell_no, row_number() OVER (PARTITION BY cell_no ORDER BY copy, md5(s), ord) AS rank_in_cell FROM p JOIN m USING (b0, b1, b2, b3))
"""
_TALLY = "WITH t AS (SELECT upper(mer) AS mer, CAST(sum(cnt) AS BIGINT) AS total FROM mer_tally WHERE mer IS NOT NULL AND cnt IS NOT NULL GROUP BY 1) "

SQL: dict[str, str] = {
    "p2_found": _FORMS + "SELECT keep_ord, ord AS copy_ord FROM c JOIN g USING (chains) WHERE ord <> keep_ord",
    "p2_groups": _FORMS + "SELECT keep_ord, copies FROM g",
    "p3_order": _VARIED + "SELECT ord, clade, cell_no, rank_in_cell FROM o",
    "p3_subsets": _VARIED + ", w AS (SELECT DISTINCT request_id, amount FROM size_requests WHERE purpose = 'subset'), q AS (SELECT *, row_number() OVER (ORDER BY rank_in_cell, cell_no) AS place FROM o) SELECT request_id, rank_in_cell, cell_no, ord, clade FROM q JOIN w ON place <= amount",
    "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_facts": "SELECT request_id, (SELECT count(*) FROM documents) AS items, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS torn FROM size_requests WHERE purpose = 'container'",
    "p4_found": _TERMS + "SELECT mer, mark FROM k WHERE mark IS NOT NULL",
    "p4_counts": _TERMS + "SELECT mer, count, records, mark FROM k",
    "p5_found": _SPANS + "SELECT ord, span_start, span_len FROM f",
    "p5_parts": _SPANS + ", t AS (SELECT ord, CAST(sum(span_len) AS BIGINT) AS shared FROM f GROUP BY ord) SELECT ord, CAST(length(s) AS BIGINT) AS residues, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / length(s), 6) AS share FROM r LEFT JOIN t USING (ord) WHERE length(s) > 0",
    "p7_found": _TALLY + "SELECT mer FROM t WHERE total >= 0.002 * (SELECT sum(total) FROM t)",
    "p7_top": _TALLY + "SELECT mer, total FROM t ORDER BY total DESC, mer LIMIT 100",
}
