import gzip
import lzma

import pytest
from conftest import rows

from merloom.sources import readers, writers


def test_fasta(spark, tmp_path):
    text = ">a b\nABC\nDE-F\n\n>c\nxyz\n>d\n"
    (tmp_path / "x.fa").write_text(text)
    (tmp_path / "y.fasta.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "z.FST.xz").write_bytes(lzma.compress(text.encode()))
    for name in ("x.fa", "y.fasta.gz", "z.FST.xz"):
        got = readers.read_sequences(spark, str(tmp_path / name)).orderBy("ord").collect()
        assert [(r["name"], r["seq"]) for r in got] == [("a b", "ABCDE-F"), ("c", "xyz"), ("d", "")]


def test_fasta_without_header(spark, tmp_path):
    (tmp_path / "x.fa").write_text("ABC\n>a\nABC\n")
    with pytest.raises(Exception, match="before the first header"):
        readers.read_fasta(spark, str(tmp_path / "x.fa"), check=True).collect()


def test_other_formats(spark, tmp_path):
    (tmp_path / "a.mase").write_text(";c1\n;c2\nn1\nAB\nCD\n;\nn2\nEF\n")
    (tmp_path / "a.tbl").write_text("# no\nn1\tx\tAB\nn2 CD\n\nsolo\n")
    (tmp_path / "a.seq").write_text("AB\n\n CD \n")
    (tmp_path / "a.nm").write_text("> n1\nn2\n")
    read = lambda n: [(r["name"], r["seq"]) for r in readers.read_sequences(spark, str(tmp_path / n)).orderBy("ord").collect()]
    assert read("a.mase") == [("n1", "ABCD"), ("n2", "EF")]
    assert read("a.tbl") == [("n1", "AB"), ("n2", "CD"), ("solo", "solo")]
    assert read("a.seq") == [("", "AB"), ("", "CD")]
    assert read("a.nm") == [("n1", ""), ("n2", "")]


def test_kinds(spark, tmp_path):
    assert readers.file_format("a/b.FA.gz") == "fasta"
    with pytest.raises(ValueError):
        readers.file_format("a.pkl")
    with pytest.raises(ValueError):
        readers.read_sequences(spark, "a.fa", "tbl")


def test_weights_file(spark, tmp_path):
    (tmp_path / "w").write_text("# head\n2.5 n1 # tail\n3 n2\n4 n1\n")
    got = [tuple(r) for r in readers.read_weights(spark, str(tmp_path / "w")).orderBy("line_no").select("weight", "name").collect()]
    assert got == [(2.5, "n1"), (3.0, "n2"), (4.0, "n1")]
    assert readers.read_weights(spark, None).count() == 0
    (tmp_path / "v").write_text("1 2 3\n")
    with pytest.raises(Exception, match="two tokens"):
        readers.read_weights(spark, str(tmp_path / "v")).collect()


@pytest.mark.parametrize("ending", ["fasta", "fa.gz", "mase", "tbl", "parquet"])
def test_round_trip(spark, tmp_path, ending):
    df = spark.createDataFrame([(i, f"n{i}", "ACDEFGHIKL"[: i % 9 + 1]) for i in range(200)], "ord bigint, name string, seq string")
    writers.write_sequences(df, f"{tmp_path}/o.{ending}", width=4)
    back = readers.read_sequences(spark, f"{tmp_path}/o.{ending}")
    assert rows(back.select("name", "seq")) == rows(df.select("name", "seq"))
    assert [r["name"] for r in back.orderBy("ord").collect()] == [f"n{i}" for i in range(200)]
