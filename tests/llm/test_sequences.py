"""Problems 1 to 5 and 7 against brute force on small tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows

from merloom.llm import format_dup, leaders, near_dup, spans, terms, varied

AMINO = "ACDEFGHIKLMNPQRSTVWY"


def _text(rng, n):
    return "".join(rng.choice(AMINO) for _ in range(n))


def _edited(rng, s):
    s = list(s)
    for _ in range(rng.randrange(0, 4)):
        s[rng.randrange(len(s))] = rng.choice(AMINO)
    if rng.random() < 0.3:
        k = rng.randrange(len(s))
        s = s[k:] + s[:k]
    return "".join(s)


def _table(seed=1):
    """Families of similar texts, copies in other writing, short, empty and null ones, one id twice."""
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        base = _text(rng, rng.randrange(60, 160))
        out += [_edited(rng, base) for _ in range(rng.randrange(1, 8))]
    out += [out[0]] * 5 + [out[3].lower(), " " + out[3][:20] + "-\n" + out[3][20:], "AC|" + out[1], out[1] + ";AC", "", None, "A", "N/A", "A" * 30, _text(rng, 20_000)]
    data = [(i, f"{'BC'[i % 2]}X.{i}", s, f"x{i}") for i, s in enumerate(out)]
    return [*data, data[2]]


def _frame(spark, data):
    return spark.createDataFrame(data, "ord bigint, name string, seq string, text string")


def _residues(s):
    return re.sub("[^A-Z]", "", (s or "").upper())


def _similar(data):
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, _, s, _ in data if len(t := _residues(s)) >= 20}
    ids = sorted(sets)
    return {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("node_rows", [2, near_dup.NODE_ROWS])
def test_near_duplicates(spark, node_rows):
    data = _table()
    links, members = near_dup.near_duplicates(_frame(spark, data), node_rows=node_rows, block_rows=3)
    got = [tuple(r) for r in near_dup.similar_rows(links, members, 20 if node_rows == 2 else near_dup.HOT_PAIRS).collect()]
    want = _similar(data)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(got) >= 0.97 * len(want)
    near = {}
    for p in got:
        for i in p:
            near[i] = near.get(i, 0) + 1
    classes = {}
    for i, _, s, _ in data:
        if len(_residues(s)) >= 20:
            classes.setdefault(_residues(s), set()).add(i)
    facts = [(i, min(c), len(c), near.get(i, 0)) for c in classes.values() for i in c]
    assert rows(near_dup.class_members(links, members)) == sorted(facts, key=repr)
    between = rows(near_dup.class_links(links, members).select("id_a", "id_b"))
    first = {i: min(c) for c in classes.values() for i in c}
    assert between == sorted({(first[a], first[b]) for a, b in got if first[a] == a and first[b] == b}, key=repr)


def test_near_duplicates_of_nothing(spark):
    links, members = near_dup.near_duplicates(_frame(spark, []))
    assert near_dup.similar_rows(links, members).count() == 0 and near_dup.class_members(links, members).count() == 0


def test_many_variants_of_one_text(spark):
    """All links of a family whose nodes are cut into blocks: as many as brute force counts, few of them by pairs of rows."""
    rng = random.Random(8)
    base = _text(rng, 150)
    data = []
    for i in range(400):
        s = list(base)
        for _ in range(rng.randrange(1, 3)):
            s[rng.randrange(150)] = rng.choice(AMINO)
        data.append((i, "n", "".join(s), ""))
    links, members = near_dup.near_duplicates(_frame(spark, data), node_rows=32, block_rows=100)
    got = {tuple(r) for r in near_dup.similar_rows(links, members).collect()}
    want = _similar(data)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 60_000


def test_windows_in_common():
    rng = np.random.default_rng(1)
    row = np.sort(rng.integers(0, 70, 4000))
    codes = rng.integers(0, 300, 4000).astype(np.uint64)
    sets = [set(codes[row == k].tolist()) for k in range(70)]
    for left in (70, 30):
        common, size = near_dup.common_windows(codes, row, 70, left)
        assert size.tolist() == [len(x) for x in sets]
        assert common.astype(int).tolist() == [[len(a & b) for b in (sets if left == 70 else sets[left:])] for a in sets[:left]]


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (9, 2), dtype=np.uint64)
    near = base[rng.integers(0, 9, 700)]
    for _ in range(8):
        near[np.arange(700), rng.integers(0, 2, 700)] ^= np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)
    rank, low = near_dup.gray_ranks(near[:, 0], near[:, 1])
    order = np.lexsort((low, rank))
    bits = (np.ascontiguousarray(near[order, 0]), np.ascontiguousarray(near[order, 1]))
    found = [p for x, y in near_dup._search(bits, np.array([0, 500]), np.array([500, 200]), 20) for p in zip(x.tolist(), y.tolist(), strict=True)]
    apart = sum(np.bitwise_count(w[:, None] ^ w[None]).astype(int) for w in bits)
    assert len(found) == len(set(found))
    assert set(found) == {(i, j) for i in range(700) for j in range(i + 1, 700) if (i < 500) == (j < 500) and apart[i, j] <= 20}


def test_gray_rank_orders_the_gray_code():
    n = np.arange(64, dtype=np.uint64)
    assert (near_dup.gray_rank(n ^ (n >> np.uint64(1))) == n).all()
    high, low = np.random.default_rng(2).integers(0, 1 << 63, (2, 50), dtype=np.uint64)
    for k, (h, b) in enumerate(zip(*near_dup.gray_bits(high, low), strict=True)):
        x = int(high[k]) << 64 | int(low[k])
        assert int(h) << 64 | int(b) == x ^ x >> 1
    assert all((a == b).all() for a, b in zip(near_dup.gray_ranks(*near_dup.gray_bits(high, low)), (high, low), strict=True))


def test_format_copies(spark):
    data = _table()
    groups = {}
    for i, _, s, _ in data:
        chains = tuple(sorted(x for x in (re.sub("[^A-Z]", "", c) for c in re.split("[|;/]", (s or "").upper())) if x))
        if sum(map(len, chains)) >= 20:
            groups.setdefault(chains, set()).add(i)
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert rows(format_dup.format_copies(_frame(spark, data)).distinct()) == sorted(want, key=repr)
    assert format_dup.format_copies(_frame(spark, [])).count() == 0


def test_term_counts(spark):
    data = _table()
    times, records, full = {}, {}, 0
    for _, _, s, _ in data:
        t = _residues(s)
        w = [t[k : k + 4] for k in range(len(t) - 3)]
        full += bool(w)
        for x in w:
            times[x] = times.get(x, 0) + 1
        for x in set(w):
            records[x] = records.get(x, 0) + 1
    want = [(x, times[x], records[x], "rare" if records[x] <= 2 else "common" if records[x] >= 0.05 * full else None) for x in times]
    assert rows(terms.term_counts(_frame(spark, data))) == sorted(want, key=repr)
    assert terms.term_counts(_frame(spark, [])).count() == 0


def _shared(data, span=25):
    where = {}
    for i, _, s, _ in data:
        t = _residues(s)
        for k in range(len(t) - span + 1):
            where.setdefault(t[k : k + span], set()).add((i, k))
    covered = {}
    for at in where.values():
        if len({i for i, _ in at}) > 1:
            for i, k in at:
                covered.setdefault(i, set()).update(range(k, k + span))
    out = []
    for i, c in covered.items():
        for p in sorted(c):
            if p - 1 not in c:
                n = p
                while n in c:
                    n += 1
                out.append((i, p + 1, n - p))
    return sorted(out, key=repr)


def test_shared_spans(spark):
    data = _table()
    assert rows(spans.shared_spans(_frame(spark, data))) == _shared(data)


def test_shared_spans_of_parts(spark, monkeypatch):
    """Texts longer than a piece are cut with an overlap; batches are combined before they are sent."""
    monkeypatch.setattr(spans, "PIECE", 300)
    rng = random.Random(5)
    long = _text(rng, 2000)
    data = [(1, "a", long, ""), (2, "b", long[250:900] + _text(rng, 50), ""), (3, "c", _text(rng, 400) + long[1500:1540], ""), (4, "d", long, ""), (5, "e", "A" * 700, ""), (6, "f", "A" * 24, "")]
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in data]), pa.array([d[2] for d in data])], ["id", "text"])
    sent = pa.Table.from_batches(list(spans._spread_windows(iter([batch]), 25, 13, 7, []))).sort_by("bucket").combine_chunks()
    covered = {}
    for b in spans._shared_runs(iter(sent.to_batches()), 25):
        for i, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            covered.setdefault(i, set()).update(range(first, first + n + 24))
    want = {}
    for i, start, n in _shared(data):
        want.setdefault(i, set()).update(range(start - 1, start - 1 + n))
    assert covered == want


@pytest.mark.parametrize("hot", [False, True])
def test_shared_spans_of_repeats_in_one_record(monkeypatch, hot):
    """A text twice in one record, or in two pieces of it, that other pieces hold too: all its places are shared."""
    monkeypatch.setattr(spans, "PIECE", 300)
    rng = random.Random(8)
    x, y = _text(rng, 30), _text(rng, 40)
    data = [(1, "a", x + _text(rng, 60) + x + "|" + x, ""), (2, "b", _text(rng, 290), ""), (3, "c", _text(rng, 20) + x, "")]
    data += [(4, "d", y + _text(rng, 400) + y, ""), (5, "e", y, ""), (6, "f", _text(rng, 290), ""), (4, "d", y + _text(rng, 5) + y, "")]
    for order in (data, data[::-1]):
        batches = [pa.RecordBatch.from_arrays([pa.array([d[0]]), pa.array([_residues(d[2])])], ["id", "text"]) for d in order]
        batches += [pa.RecordBatch.from_arrays([pa.array([d[0] for d in order]), pa.array([_residues(d[2]) for d in order])], ["id", "text"])]
        for sent in (batches[:-1], batches[-1:]):
            mers = [m for b in spans._mer_counts(iter(sent), 25, 13) for m in b.column(0).to_pylist()[:: 2]] if hot else []
            table = pa.Table.from_batches(list(spans._spread_windows(iter(sent), 25, 13, 7, mers))).sort_by("bucket").combine_chunks()
            got = {}
            for b in spans._shared_runs(iter(table.to_batches()), 25, 30 if hot else spans.HELD):
                for i, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    got.setdefault(i, set()).update(range(first, first + n + 24))
            want = {}
            for i, start, n in _shared(data):
                want.setdefault(i, set()).update(range(start - 1, start - 1 + n))
            assert got == want


def test_a_mer_in_a_third_of_the_records(spark):
    """The mer is known as hot, its windows go to many buckets, and nothing that is shared is lost."""
    rng = random.Random(9)
    mer = _text(rng, 13)
    data = []
    for i in range(3000):
        s = _text(rng, 60)
        data.append((i, "n", s[:30] + mer + s[30:] if i % 3 == 0 else s, ""))
    data += [(3000 + i, "n", data[3 * i][2][5:65], "") for i in range(40)]
    df = _frame(spark, data)
    hot = spans.hot_mers(df.selectExpr("ord AS id", "seq AS text"), 1, 1 / 2000, 25, 13)
    assert 1 <= len(hot) < 50
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in data]), pa.array([d[2] for d in data])], ["id", "text"])
    most = []
    for known in ([], hot):
        size = {}
        for b in spans._spread_windows(iter([batch]), 25, 13, 256, known):
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                size[k] = size.get(k, 0) + len(x or b"")
        most.append(max(v for k, v in size.items() if k is not None) / sum(size.values()))
    assert most[0] > 0.02 and most[1] < most[0] / 2
    assert rows(spans.shared_spans(df)) == _shared(data)


def test_shared_parts(spark):
    data = _table()
    got = {r["id"]: (r["residues"], r["shared"]) for r in spans.shared_parts(_frame(spark, data)).collect()}
    share = {}
    for i, _, n in _shared(data):
        share[i] = share.get(i, 0) + n
    assert got == {i: (len(_residues(s)), share.get(i, 0)) for i, _, s, _ in data if _residues(s)}


def test_heavy_values(spark):
    rng = random.Random(1)
    data = [(rng.choice(["aa", "AA", "b"]) if rng.random() < 0.5 else f"v{rng.randrange(300)}", rng.choice([None, *range(9)])) for _ in range(3000)] + [(None, 5)]
    df = spark.createDataFrame(data, "mer string, cnt bigint").repartition(5)
    total = {}
    for v, n in data:
        if v is not None and n is not None:
            total[v.upper()] = total.get(v.upper(), 0) + n
    bound = 0.004 * sum(total.values())
    assert rows(leaders.heavy_values(df, share=0.004)) == sorted(((v, n) for v, n in total.items() if n >= bound), key=repr)
    want = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert rows(leaders.heavy_values(df, k=10)) == sorted(want, key=repr)
    assert leaders.heavy_values(df.limit(0), k=3).count() == 0


def test_heavy_values_by_nodes(spark):
    """The same result with few and with many nodes, and when candidates are joined by a shuffle."""
    rng = random.Random(6)
    data = [(f"v{int(200 * rng.random() ** 4)}", rng.randrange(9)) for _ in range(2000)]
    df = spark.createDataFrame(data, "mer string, cnt bigint")
    want = rows(leaders.heavy_values(df.coalesce(1), share=0.01))
    assert len(want) > 5
    assert rows(leaders.heavy_values(df.repartition(64), share=0.01, broadcast_rows=0)) == want
    assert rows(leaders.heavy_values(df.repartition(8), k=len(want), broadcast_rows=0)) == want


def test_varied_subsets(spark):
    rng = random.Random(2)
    data = [(i, f"{'BBBBBBCD'[i % 8]}{i % 3}.X.{i}", _text(rng, rng.randrange(20, 200)), "") for i in range(120)] + [(500, "B.x", "AC", ""), (501, None, None, ""), (502, None, "A" * 40, ""), (503, "", "A" * 40, "")]
    df = _frame(spark, data)
    wanted = spark.createDataFrame([(1, 5), (2, 40), (3, 1000), (4, None), (5, 0)], "request_id int, amount bigint")
    got = varied.varied_subsets(df, wanted).collect()
    order = varied.varied_order(df).orderBy("rank_in_cell", "cell_no").collect()
    assert len(order) == 121
    assert len({(r["rank_in_cell"], r["cell_no"]) for r in order}) == 121
    for request, k in ((1, 5), (2, 40), (3, 121)):
        assert {r["id"] for r in got if r["request_id"] == request} == {r["id"] for r in order[:k]}
    assert {r["request_id"] for r in got} == {1, 2, 3}
    assert len({r["clade"] for r in order[:5]}) == 5


def test_requests_are_met_with_copies(spark):
    rng = random.Random(4)
    hot = _text(rng, 80)
    data = [(i, f"B.{i}", hot if i % 3 else _text(rng, 60), "") for i in range(60)] + [(100, "B.x", "AC", ""), (101, None, None, ""), (102, "", "", "")]
    df = _frame(spark, data).repartition(3)
    wanted = spark.createDataFrame([(1, 30), (2, 63), (3, 1000)], "request_id int, amount bigint")
    got = varied.varied_subsets(df, wanted, whole=True).collect()
    order = varied.varied_order(df, whole=True).orderBy("rank_in_cell", "cell_no").collect()
    assert {r["id"] for r in order} == {d[0] for d in data} and len({(r["rank_in_cell"], r["cell_no"]) for r in order}) == 63
    for request, k in ((1, 30), (2, 63), (3, 63)):
        assert sorted(r["id"] for r in got if r["request_id"] == request) == sorted(r["id"] for r in order[:k])
    cell = [r["id"] for r in order if r["cell_no"] == next(x["cell_no"] for x in order if x["id"] == 1)]
    assert [i for i in cell if i < 100 and i % 3] == [i for i in range(60) if i % 3]


def test_a_third_of_all_rows_are_copies(spark):
    rng = random.Random(7)
    hot = _text(rng, 80)
    data = [(i, None, hot if i % 3 == 0 else _text(rng, 60), "") for i in range(300)]
    data.append((1000, "n", _text(rng, 10) + hot[:40], ""))
    df = _frame(spark, data).repartition(3)
    links, members = near_dup.near_duplicates(df)
    assert members.groupBy("class").count().agg({"count": "max"}).first()[0] == 100
    assert near_dup.similar_rows(links, members).count() == 100 * 99 // 2
    copies = format_dup.format_copies(df).collect()
    assert {r["copy"] for r in copies} == set(range(3, 300, 3)) and {r["keep"] for r in copies} == {0}
    got = {r["id"]: (r["span_start"], r["span_len"]) for r in spans.shared_spans(df).collect()}
    assert got == {i: (1, 80) for i in range(0, 300, 3)} | {1000: (11, 40)}


def test_clashing_and_null_columns(spark):
    """Columns named like the operators' own, and null ids, change nothing."""
    text = "ACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQ"
    df = spark.createDataFrame([(1, text, 5, "x"), (2, text.lower(), 6, "y"), (None, text, 7, None)], "ord bigint, seq string, id int, text string").selectExpr("*", "1 AS node", "'k' AS key", "0 AS rank", "2 AS cell", "3 AS bucket")
    links, members = near_dup.near_duplicates(df)
    assert rows(near_dup.similar_rows(links, members)) == [(1, 2)]
    assert rows(format_dup.format_copies(df)) == [(1, 2)]
    assert rows(spans.shared_spans(df)) == [(1, 1, 34), (2, 1, 34)]
    assert terms.term_counts(df).agg({"records": "max"}).first()[0] == 3
