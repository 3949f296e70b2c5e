import csv
import io
import re

import pytest
from conftest import rows

from merloom.operators import raw_rows
from merloom.operators.skew import salted_join


def _lines(spark, *lines):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(lines)], "raw_id bigint, line string, errors int")


CASES = {
    "1,a,ACD,1.5": None,
    "1,a,ACD,1.5\r": None,
    '"1","a ""b"", c","AC\nD",2': "value",
    '"1","a ""b"", c","AC-*d",+2.e1': None,
    " 7 , a ,acd, .5 ": None,
    "1,a,ACD": "columns",
    "": "columns",
    '""': "columns",
    '1,"a,ACD,1': "quoting",
    '1,a"b,ACD,1': "quoting",
    '1,"a"b,ACD,1': "quoting",
    ' "1",a,ACD,1': "quoting",
    "1,,ACD,1": "value",
    '1,"  ",ACD,1': "value",
    "1,a,AC D,1": "value",
    "1,a,ACD,0": "value",
    "1,a,ACD,-1": "value",
    "1,a,ACD,1e999": "value",
    "1,a,ACD,1e-999": "value",
    "1,a,ACD,nan": "value",
    "1,a,ACD,1f": "value",
    "1,a,ACD,.": "value",
    "1234567890123456789,a,ACD,1": "value",
    "123456789012345678,a,ACD,1": None,
    "1,a,ACD\n,1": "value",
    "1,\\c\\b,ACD,1": None,
    '1,"\\,\\b",ACD,1': None,
}


def test_reasons(spark):
    df = _lines(spark, *CASES, "# 1,2", None)
    got = {r["raw_id"]: r["reason"] for r in raw_rows.failed_rows(df).collect()}
    assert {k: got.get(i) for i, k in enumerate(CASES)} == CASES
    assert len(CASES) not in got and got[len(CASES) + 1] == "columns"


def test_values_are_read_as_csv_does(spark):
    good = [k for k, v in CASES.items() if v is None]
    got = rows(raw_rows.valid_rows(_lines(spark, *good)).select("ord", "name", "seq", "weight"))
    want = []
    for k in good:
        a, b, c, w = (x.strip(" ") for x in next(csv.reader(io.StringIO(re.sub("\r$", "", k), newline=""))))
        want.append((int(a), b, c, float(w)))
    assert got == sorted(want, key=repr)


def test_empty_table_and_long_line(spark):
    assert raw_rows.failed_rows(_lines(spark, "x").limit(0)).count() == 0
    long = '1,"' + '""' * 50_000 + 'a",' + "A" * 100_000 + ",1"
    assert raw_rows.valid_rows(_lines(spark, long)).count() == 1


@pytest.mark.parametrize("hot", [1, 1000])
def test_salted_join(spark, hot):
    left = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(50)] + [(99, None)], "id bigint, key string")
    groups = left.groupBy("key").count().where("key is not null")
    got = salted_join(left, groups, "key", "count", hot_rows=hot)
    assert sorted(r["id"] for r in got.collect()) == list(range(50))
