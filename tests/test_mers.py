from itertools import product

import pytest
from conftest import rows
from pyspark.sql import functions as F

from merloom.functions import mers as M
from merloom.operators import columns, coverage, filters, greedy, offby, tally


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def _seqs(spark, *texts):
    return spark.createDataFrame([(i, f"n{i}", t) for i, t in enumerate(texts)], "ord bigint, name string, seq string")


def test_windows_of_a_text(spark):
    assert _one(spark, M.mers(F.col("s"), 3), s="ABCDEFABCG") == ["ABC", "BCD", "CDE", "DEF", "EFA", "FAB", "ABC", "BCG"]
    assert set(_one(spark, M.tiled_mers(F.col("s"), 3), s="ABCDEFABCG")) == {"ABC", "BCD", "CDE", "DEF", "EFA", "FAB", "BCG"}
    assert _one(spark, M.mers(F.col("s"), 3), s="A-Bx-CDE") == ["CDE"]
    assert _one(spark, M.mers(F.col("s"), 9), s="ABC") == []


def test_windows_of_long_and_missing_texts(spark):
    text = "".join(chr(65 + i * i % 26) for i in range(1500))
    assert _one(spark, M.mers(F.col("s"), 9), s=text) == [text[i : i + 9] for i in range(len(text) - 8)]
    df = _seqs(spark, None, "", "AB")
    assert tally.mer_tally(df, 3).count() == 0


def test_tiles_end_with_a_short_one(spark):
    assert _one(spark, M.tiled_mers(F.col("s"), 4, 3), s="ABCDEFGHI") == ["ABCD", "DEFG", "GHI"]
    assert _one(spark, M.tiled_mers(F.col("s"), 4, 3), s="") == []


def test_gapped_windows(spark):
    df = spark.createDataFrame([(1, "A-B---CDEF"), (2, "A-B-------"), (3, "-B---CDDEF"), (4, ""), (5, None), (6, "--")], "ord bigint, seq string")
    got = M.gapped_rows(df, 3, ["ord"], gapped=True).orderBy("ord", "pos").collect()
    assert [tuple(r) for r in got if r.ord == 1] == [(1, 0, "ABC", "A-B---C"), (1, 2, "BCD", "B---CD"), (1, 6, "CDE", "CDE"), (1, 7, "DEF", "DEF")]
    assert {r.ord for r in got} == {1, 3} and min(r.pos for r in got if r.ord == 3) == 1
    assert rows(M.gapped_rows(df, 3, ["ord"])) == sorted(((r.ord, r.pos, r.mer) for r in got), key=repr)


def test_long_texts_are_cut_in_chunks(spark):
    text = "".join("ABCDEFGHIJKLM"[i * i % 13] for i in range(1500))
    for k, stride in ((15, 1), (15, 7), (300, 200), (4, 3)):
        n = max(0, -(-(len(text) - k) // stride) + 1)
        assert _one(spark, M.tiled_mers(F.col("s"), k, stride), s=text) == list(dict.fromkeys(text[i * stride : i * stride + k] for i in range(n)))
    assert _one(spark, M.residue_places(F.col("s")), s="-A-" * 400) == [3 * i + 1 for i in range(400)]


def test_text_functions(spark):
    df = spark.createDataFrame([(["ABC", "BCD", "CDE"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(M.mers_to_text(F.col("p"))).collect()] == ["ABCDE", ""]
    assert _one(spark, M.hamming(F.col("a"), F.col("b")), a="ABCD", b="AXCX") == 2
    assert _one(spark, M.relative_name(F.col("a"), F.col("b")), a="ABC", b="ABD") == "..D"
    assert _one(spark, M.places_of(F.col("s"), "b"), s="abcb") == [1, 3]
    assert _one(spark, M.repeated_mers(F.col("s"), 2), s="ABABXX") == ["AB"]
    keys = [_one(spark, M.cyclic_key(F.col("s"), k, 4), s=s) for s, k in (("xxxABCDxx", 3), ("xxxxABCDx", 4), ("CDxxxxxAB", 7))]
    assert keys == ["ABCD"] * 3
    with pytest.raises(Exception, match="different length"):
        _one(spark, M.hamming(F.col("a"), F.col("b")), a="AB", b="A")


def test_cleaning_and_first_of_each(spark):
    assert _one(spark, filters.cleaned(F.col("s"), badchar="x"), s="abx#$*-X") == "ABxx**-x"
    df = _seqs(spark, "AB", "", "AB", None, "", "CD")
    assert [r[0] for r in rows(filters.first_of_each(df).select("ord"))] == [0, 1, 3, 4, 5]
    assert filters.filtered(df, rmdup=True, maxseqs=2).count() == 2


def test_name_patterns(spark):
    df = spark.createDataFrame([(0, "first", "A"), (1, "Bx", "A"), (2, None, "A"), (3, "by", "A")], "ord bigint, name string, seq string")
    assert [r[0] for r in rows(filters.by_pattern(df, "^B").select("ord"))] == [1]
    assert [r[0] for r in rows(filters.by_pattern(df, None, "^B").select("ord"))] == [0, 2, 3]
    assert [r[0] for r in rows(filters.by_patterns(df, ["^b"], keepfirst=True).select("ord"))] == [0, 1, 3]
    assert filters.by_patterns(df, ["Global"]).count() == 4


def test_repeats_and_ranges(spark):
    df = _seqs(spark, "ABABCC", "ABCDEF", "ABABCDCD")
    assert [r[0] for r in rows(filters.few_repeats(df, 2, 2).select("ord"))] == [0, 1]
    assert [r[0] for r in rows(filters.few_repeats(df, 2, 1).select("ord"))] == [1]
    assert filters.few_repeats(df, 2, 0).count() == 3
    with pytest.raises(ValueError):
        filters.truncated(F.col("seq"), 3, 2)
    with pytest.raises(Exception, match="ends before"):
        df.select(filters.truncated(F.col("seq"), 7, 9)).collect()
    with pytest.raises(Exception, match="different length"):
        filters.same_length(df).collect()


def test_numbers_and_draws(spark):
    df = spark.range(100).select((F.col("id") * 7 % 101).alias("ord"), F.lit("n").alias("name"), F.lit("AB").alias("seq"))
    assert [r["_n"] for r in filters.numbered(df).orderBy("ord").collect()] == list(range(100))
    assert filters.drawn(df, 50, 3).count() == 50


def test_weights(spark):
    w = spark.createDataFrame([(0, 2.0, "n0"), (1, 3.0, "n0"), (2, None, "n1"), (3, 5.0, None)], "line_no bigint, weight double, name string")
    table = tally.weight_table(w)
    df = _seqs(spark, "ABC", "ABC")
    assert rows(tally.weighted_tally(df, table, 3)) == [("ABC", 4.0)]
    with pytest.raises(Exception, match="no weight"):
        tally.weighted(df, table, strict=True).collect()


def test_blocked_join_is_brute_force(spark):
    texts = ["".join(p) for p in product("AB", repeat=5)]
    df = spark.createDataFrame([(t,) for t in texts], "mer string")
    want = sorted((a, b) for a in texts[:9] for b in texts if sum(x != y for x, y in zip(a, b, strict=True)) <= 2)
    got = offby.near_mers(df, df.where(F.col("mer").isin(texts[:9])), 5, 2)
    assert sorted((r["mer"], r["near_mer"]) for r in got.collect()) == want
    spread = offby.near_mers(df, df.where(F.col("mer").isin(texts[:9])), 5, 2, most=0, hot_pairs=10)
    assert sorted((r["mer"], r["near_mer"]) for r in spread.collect()) == want
    assert offby.neighbours(df, df, 5, 1).where("mer = near_mer").count() == 0
    with pytest.raises(ValueError, match="below e"):
        offby.near_mers(df, df, 5, 5)


def test_coverage_curves(spark):
    pop, ant = _seqs(spark, "ABCD", "BCDE", "", None), _seqs(spark, "ABC", "CDE")
    assert rows(coverage.micro_curve(pop, ant, 3).select("k", "covered", "total")) == [(1, 1, 4), (2, 2, 4)]
    macro = rows(coverage.macro_curve(pop, ant, 3))
    assert [round(m, 6) for _, m in macro] == [75.0, 50.0]
    with pytest.raises(Exception, match="without a mer"):
        coverage.macro_curve(pop, ant, 3, on_empty="error").collect()
    curve = coverage.offby_curve(pop, ant, 3, 1)
    plain = {r["k"]: r["covered"] for r in curve.where("dist = 0").collect()}
    assert plain == {1: 1, 2: 2}
    assert rows(coverage.rarest(pop, ant, 3)) == [(1, 2)]
    assert rows(coverage.site_curve(_seqs(spark, "ABCD", "BCDE"), ant, 3).where("k = 2").select("pos", "missed")) == [(0, 50.0), (1, 50.0)]


def test_columns(spark):
    df = _seqs(spark, "A-CX", "A-DX", "B-CX")
    assert rows(columns.consensus(df).select("pos", "ch")) == [(0, "A"), (1, "-"), (2, "C"), (3, "X")]
    assert rows(columns.gap_columns(df)) == [(1,)]
    assert rows(columns.without_gap_columns(df).select("seq")) == [("ACX",), ("ADX",), ("BCX",)]
    assert rows(columns.without_master_gaps(df).select("seq")) == [("ACX",), ("ADX",), ("BCX",)]
    assert [r["pos"] for r in columns.entropy(df).collect()].count(3) == 0
    assert rows(columns.column(df, [0, 3])) == []


def test_greedy_gain_is_recomputed_score(spark):
    df = _seqs(spark, "ABCDEFG", "ABCDXYZ", "QRSTUVW", "ABCDEFG")
    members = greedy.member_counts(df, 5, 3)
    picks = greedy.greedy(members, 3)
    pool = spark.createDataFrame([(m,) for m, _ in picks], "kmer string")
    assert greedy.union_score(pool, tally.mer_tally(df, 3), 3).first()[0] == sum(s for _, s in picks)
    assert picks[0][0] == "ABCDE"
    refined = greedy.refined(members, 3, 1)
    assert sum(s for _, s in refined) >= sum(s for _, s in picks)
    top = greedy.top_mers(df, 5, 3, 3, initial=_seqs(spark, "ZBCDE")).orderBy("pick").collect()
    assert top[0]["kmer"] == "ZBCDE" and top[0]["score"] == 5 and len(top) == 3


def test_bootstrap_within_a_distance(spark):
    """One sequence has the same share in each resample that draws it; distance 0 is the exact bootstrap."""
    pop, ant = _seqs(spark, "ABCDE"), _seqs(spark, "ABX", "QBCD")
    got = rows(coverage.offby_bootstrap(pop, ant, 3, 1))
    assert [(k, dist, round(mean, 6), spread) for k, dist, mean, spread in got] == [(1, 0, 0.0, 0.0), (1, 1, 0.333333, 0.0), (2, 0, 0.333333, 0.0), (2, 1, 0.666667, 0.0)]
    assert [(k, mean) for k, dist, mean, _ in got if not dist] == [(k, mean) for k, mean, _ in rows(coverage.bootstrap(pop, ant, 3))]


def test_curves_of_an_empty_population(spark):
    pop, ant = _seqs(spark, "", None), _seqs(spark, "ABC", "CDE")
    assert rows(coverage.micro_curve(pop, ant, 3)) == [(1, 0, 0, None), (2, 0, 0, None)]
    assert rows(coverage.macro_curve(pop, ant, 3)) == [(1, None), (2, None)]
    assert {r["cnt"] for r in coverage.antigen_mers(pop, ant, 3).collect()} == {0.0}
    assert coverage.site_curve(pop, ant, 3).count() == 0
    assert rows(coverage.bootstrap(pop, ant, 3)) == []
    assert rows(coverage.offby_bootstrap(pop, ant, 3, 1)) == []
    assert coverage.micro_curve(pop, ant.limit(0), 3).count() == 0
