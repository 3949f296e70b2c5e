from conftest import rows

from merloom import cli


def test_commands(spark, tmp_path):
    (tmp_path / "p.fa").write_text(">a\nABC-DEF\n>b\nABCDXF\n>c\nBCDEFG\n")
    (tmp_path / "a.fa").write_text(">x\nABCD\n>y\nEFG\n")
    base = [f"{tmp_path}/p.fa", f"{tmp_path}/a.fa", "-E", "3"]
    for command in ("micro", "macro", "sites", "counts", "bootstrap"):
        cli.main([command, *base, "--out", f"{tmp_path}/{command}"])
    micro = spark.read.parquet(f"{tmp_path}/micro")
    assert rows(micro.where("dist = 0").select("k", "covered")) == [(1, 5), (2, 6)]
    cli.main(["top", f"{tmp_path}/p.fa", "-K", "5", "-E", "3", "-N", "2", "--out", f"{tmp_path}/top"])
    assert spark.read.parquet(f"{tmp_path}/top").count() == 2
