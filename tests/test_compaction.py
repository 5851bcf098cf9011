import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import changes, running

C, U, R, S, E = "created", "updated", "removed", "restored", "error"


def plain(steps, *, suppress=True, longest=False):
    """One key's changes, one after the other."""
    state = None
    for kind, pre, post in steps:
        if state is None:
            state = (kind, pre, post if kind != R else None)
            continue
        was, first, last = state
        merged = post if not longest or last is None or post is None or post >= last else last
        if kind == U and was in (C, U, S):
            state = (was, first, merged)
        elif kind == R and was == C:
            state = None
        elif kind == R and was == U:
            state = (R, first, None)
        elif kind == R and was == S:
            state = None if suppress else (R, pre, None)
        elif kind == C and was == R:
            state = (U, first, post)
        else:
            return E, None, None
    return state


def frame(spark, keys):
    rows = [(k, i, kind, pre, post) for k, steps in enumerate(keys) for i, (kind, pre, post) in enumerate(steps)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "key long, ord long, kind string, pre long, post long").repartition(5)


def steps_of(kinds, rng):
    return [(k, None if k in (C,) else rng.randrange(1000), None if k == R else rng.randrange(1000)) for k in kinds]


@pytest.mark.parametrize("suppress", [True, False])
@pytest.mark.parametrize("longest", [False, True])
@pytest.mark.parametrize("hot", [None, 3])
def test_every_order_of_kinds_like_one_by_one(spark, monkeypatch, suppress, longest, hot):
    """All sequences of up to four kinds, and long ones; also with every key of three changes or more dealt by ranges."""
    monkeypatch.setattr(running, "FREQUENT", 1_000_000)
    rng = random.Random(2)
    keys = [steps_of(kinds, rng) for n in range(1, 5) for kinds in itertools.product((C, U, R, S), repeat=n)]
    for _ in range(60):  # long ones that mostly fit
        kinds, there = [], rng.random() < 0.5
        for _ in range(rng.randrange(5, 60)):
            if rng.random() < 0.01:
                kinds.append(S)
            elif there:
                kinds.append(U if rng.random() < 0.6 else R)
                there = kinds[-1] == U
            else:
                kinds.append(C if kinds or rng.random() < 0.7 else S)
                there = True
        keys.append(steps_of(kinds, rng))
    got = changes.compacted(frame(spark, keys), keys=["key"], order=["ord"], suppress_remove_after_restore=suppress, longest=longest, on_error="mark", hot_rows=hot)
    found = {r.key: tuple(r)[1:] for r in got.collect()}
    want = {k: w for k, steps in enumerate(keys) if (w := plain(steps, suppress=suppress, longest=longest))}
    assert found == want


def test_values_are_whole_entries(spark):
    entry = "struct<amount:long,until:long>"
    rows = [(1, 1, U, (1, 5), (2, 9)), (1, 2, U, (2, 9), (3, 7)), (1, 3, U, (3, 7), (4, 9)), (2, 1, R, (7, 7), None), (3, 1, "moved", None, None), (4, 1, None, None, None), (None, 1, C, None, (1, 1))]
    df = spark.createDataFrame(rows, f"key long, ord long, kind string, pre {entry}, post {entry}")
    got = {r.key: (r.kind, r.pre and tuple(r.pre), r.post and tuple(r.post)) for r in changes.compacted(df, keys=["key"], order=["ord"], longest="until", on_error="mark").collect()}
    assert got == {1: (U, (1, 5), (4, 9)), 2: (R, (7, 7), None), 3: (E, None, None), 4: (E, None, None), None: (C, None, (1, 1))}
    assert {r.key: tuple(r.post) for r in changes.compacted(df.where("key = 1 and ord < 3"), keys=["key"], order=["ord"], longest="until").collect()} == {1: (2, 9)}
    with pytest.raises(Exception, match="change not allowed for key 3"):
        changes.compacted(df, keys=["key"], order=["ord"]).collect()
    assert changes.compacted(df.where("false"), keys=["key"], order=["ord"]).collect() == []


def test_a_million_changes_of_one_key(spark):
    n = 1_000_000
    kind = F.when(F.col("id") == 0, C).when(F.col("id") % 10 == 9, R).when(F.col("id") % 10 == 0, C).otherwise(U)
    df = spark.range(n).select(F.lit(7).alias("key"), F.col("id").alias("ord"), kind.alias("kind"), (-F.col("id")).alias("pre"), F.col("id").alias("post"))
    df = df.unionByName(spark.range(1).select(F.lit(8).alias("key"), F.lit(0).cast("long").alias("ord"), F.lit(U).alias("kind"), F.lit(1).cast("long").alias("pre"), F.lit(2).cast("long").alias("post")))
    got = changes.compacted(df.where(f"ord < {n - 3} or key = 8"), keys=["key"], order=["ord"], hot_rows=100_000)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == [(7, C, -(n - 10), n - 4), (8, U, 1, 2)]


@pytest.mark.parametrize("hot", [None, 5])
def test_running_sums_and_last_values(spark, monkeypatch, hot):
    monkeypatch.setattr(running, "FREQUENT", 50)
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None, f"k{i % 40}"]), i, rng.choice([None, 1, 5, -2]), rng.choice([None, None, "x", "y"])) for i in range(400)]
    df = spark.createDataFrame(rows, "`k.1` string, i long, v long, t string").repartition(7)
    got = running.before(df, keys=["k.1"], order=["i"], sums={"s": F.col("v").cast("decimal(38,0)")}, lasts={"l": F.col("t")}, hot_rows=hot)
    assert got.columns[:4] == ["k.1", "i", "v", "t"]
    total, last, want = {}, {}, {}
    for k, i, v, t in rows:
        want[i] = (total.get(k, 0), last.get(k))
        total[k] = total.get(k, 0) + (v or 0)
        last[k] = t or last.get(k)
    assert {r.i: (int(r.s), r.l) for r in got.collect()} == want
