import collections
import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup
from tallyloom.llm.exact_dedup import TextTable, copy_groups, drop_copies

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string"


def plain(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = max(known, default=None)
        digest = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, best, len(ids), k == 0, digest) for k, i in enumerate(sorted(ids, key=lambda i: (i is None, -(i or 0))))]
    return sorted(map(str, out))


ROWS = [(1, "Abc"), (2, "aBC"), (2, "abc"), (7, "abc"), (7, "ABC"), (3, None), (4, ""), (None, "É"), (None, "É"), (5, "é"), (6, "É"), (8, "x " * 50_000), (9, "X " * 50_000), (10, "x " * 50_000 + "y"), (11, "a\u0000"), (12, "a"), (None, "a")]


@pytest.mark.parametrize(("chunk", "table"), [(1 << 24, 1 << 25), (10, 1 << 25), (10, 5), (1 << 24, 0)])
def test_groups_like_brute_force(spark, monkeypatch, chunk, table):
    monkeypatch.setattr(exact_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(exact_dedup, "TABLE_BYTES", max(table, 1))
    if not table:  # nothing but the first text fits: the levels do all
        monkeypatch.setattr(exact_dedup, "_spilled", lambda d, *a, f=exact_dedup._spilled: f(d.coalesce(1), *a))
    rows = ROWS if table > 5 else ROWS[:7] + ROWS[-3:]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("token", F.lit(1)).withColumn("a.b", F.lit(2)).repartition(3)
    if table <= 5:
        monkeypatch.setattr(exact_dedup, "TABLE_BYTES", 6)
    assert sorted(str(tuple(r)) for r in copy_groups(docs).collect()) == plain(rows)


def test_a_common_text_meets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CHUNK_BYTES", 40)
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 5)
    monkeypatch.setattr(exact_dedup, "FREQUENT", 20)
    monkeypatch.setattr(exact_dedup, "SALTS", 4)
    rows = [(i, "the same text Again" if i % 3 == 0 else f"text {i // 2}") for i in range(600)]
    assert sorted(str(tuple(r)) for r in copy_groups(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()) == plain(rows)


def test_equal_hashes_are_no_equal_texts(spark, monkeypatch):
    table = TextTable(1 << 20)
    assert [table.place(7, t) for t in (b"a", b"b", b"a", b"c", b"b")] == [0, 1, 0, 2, 1]
    small = TextTable(3)
    assert [small.place(h, t) for h, t in ((1, b"longer than that"), (2, b"x"), (1, b"longer than that"))] == [0, -1, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.binary(max_size=2)), max_size=300))
def test_table_against_a_dict(items):
    table, seen = TextTable(1 << 20), {}
    for item in items:
        assert table.place(*item) == seen.setdefault(item, len(seen))


def test_rows_that_stay_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "A", 1.5, None), (2, "a", 2.5, "s"), (3, None, 3.5, "t"), (None, "", 4.5, "u"), (4, "Z", 5.5, "v")], "doc_id int, text string, `a.b` double, row string")
    got = drop_copies(docs)
    assert got.schema.names == docs.schema.names and got.dtypes == docs.dtypes
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(2, "a", 2.5, "s"), (3, None, 3.5, "t"), (4, "Z", 5.5, "v")]))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert copy_groups(empty).collect() == [] and drop_copies(empty).collect() == []
    assert copy_groups(empty).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
