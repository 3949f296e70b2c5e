import pytest

from merloom.operators.graph import BEGIN, END
from merloom.operators.paths import greedy_way, half_kept_way, random_way
from merloom.plans.design import Design, design


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Tiny tables and many jobs: one task a stage."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def _seqs(spark, *texts):
    return spark.createDataFrame([(i, f"n{i}", t) for i, t in enumerate(texts)], "ord bigint, name string, seq string")


def test_design_covers_two_families(spark):
    """Hints and names are taken."""
    df = _seqs(spark, "ABCDE", "ABCDE", "QRSTU", "ABCAB", "", None)
    got = design(df, Design(e=3, m=2, hints=["ABCDE"], names=["first"])).orderBy("path_id").collect()
    assert {r["seq"] for r in got} == {"ABCDE", "QRSTU"}
    assert [r["name"] for r in got] == ["first", "EG-1"] and 0 < got[0]["share"] <= 1
    with pytest.raises(ValueError):
        design(df, Design(e=3, m=1, trials=2))


def test_random_and_greedy_ways(spark):
    edges = spark.createDataFrame([(BEGIN, "a"), (BEGIN, "p"), ("a", "b"), ("b", END), ("p", "q"), ("q", END)], "src string, dst string")
    nodes = spark.createDataFrame([("a", 1), ("b", 9), ("p", 2), ("q", 1), (BEGIN, 0), (END, 0)], "mer string, cnt bigint")
    assert greedy_way(nodes, edges) == ["p", "q"]
    assert random_way(edges, "3") in (["a", "b"], ["p", "q"])
    assert half_kept_way(edges, ["a", "b"], "5") == ["a", "b"]


def test_design_of_nothing(spark):
    with pytest.raises(ValueError):
        design(_seqs(spark, "", None), Design(e=3))
