import pytest
from pyspark.sql import functions as F

from tallyloom.operators import buckets, event_filters, fees, flatten, paging, projections
from tallyloom.sources import history

RECORD = "hash string, n int, kind string, protocol int, list_type string, key string, type string, value int"


def state(spark, *levels, sequence=63):
    return spark.createDataFrame([(sequence, list(levels))], "sequence int, levels array<struct<curr:string,snap:string>>")


def records(spark, rows):
    """Rows of (hash, n, kind, key, type, value); a meta record has (protocol, list) in place of key and type."""
    return spark.createDataFrame([(h, n, k, *((a, b, None, None) if k == "meta" else (None, None, a, b)), v) for h, n, k, a, b, v in rows], RECORD)


def held(df):
    return sorted((r["key"], r["value"]) for r in df.collect())


def test_buckets_in_order_and_checkpoints_only(spark):
    rows = buckets.listed(state(spark, ("a", "b"), (buckets.ZERO, "c"), ("d", "")), sequence=63)
    assert sorted(map(tuple, rows.collect())) == [(0, "a"), (1, "b"), (3, "c"), (4, "d")]
    with pytest.raises(ValueError, match="checkpoint"):
        buckets.listed(state(spark, ("a", "b")), sequence=64)
    assert buckets.listed(state(spark, ("a", "b"), sequence=7), sequence=7, every=8).count() == 2


def test_live_entries_hide_older_ones(spark):
    listed = buckets.listed(state(spark, ("a", "b"), ("c", "")), sequence=63)
    rows = records(spark, [
        ("a", 0, "meta", 22, "live", None), ("b", 0, "meta", 22, None, None),
        ("a", 1, "live", "x", "account", 1), ("b", 1, "live", "x", "account", 2), ("c", 0, "live", "x", "account", 3),
        ("a", 2, "dead", "y", "account", None), ("b", 2, "live", "y", "account", 5),
        ("a", 3, "init", "z", "account", 6), ("b", 3, "dead", "z", "account", None), ("c", 1, "live", "z", "account", 8),
        ("a", 4, "dead", "o", "offer", None), ("b", 4, "init", "o", "offer", 9), ("c", 2, "live", "o", "offer", 10),
        ("a", 5, "dead", "p", "account", None), ("b", 5, "init", "p", "account", 11), ("c", 3, "live", "p", "account", 12),
        ("other", 0, "odd", "q", "account", 13),
    ])
    # What an init of a unique id clears is read again; elsewhere what was seen stays seen.
    assert held(buckets.live_entries(rows, listed)) == [("o", 10), ("x", 1), ("z", 6)]
    kept = buckets.live_entries(rows, listed, keep_entry=F.col("value") > 1, keep_key=F.col("key") != "y")
    assert held(kept) == [("o", 10), ("x", 2), ("y", 5), ("z", 6)]


def test_archived_entries(spark):
    listed = buckets.listed(state(spark, ("a", "b")), sequence=63)
    rows = records(spark, [
        ("a", 0, "meta", 23, "hot_archive", None), ("b", 0, "meta", 23, "hot_archive", None),
        ("a", 1, "live", "x", "account", None), ("b", 1, "archived", "x", "account", 1),
        ("a", 2, "archived", "y", "account", 2), ("b", 2, "archived", "y", "account", 3), ("b", 3, "archived", "z", "account", 4),
    ])
    assert held(buckets.archived_entries(rows, listed)) == [("y", 2), ("z", 4)]
    assert held(buckets.archived_entries(rows, listed, keep_key=F.lit(False))) == [("x", 1), ("y", 2), ("z", 4)]


@pytest.mark.parametrize(
    ("kind", "rows", "fault"),
    [
        ("live", [("a", 0, "live", "x", "account", 1), ("a", 1, "meta", 22, "live", None)], "meta not first"),
        ("live", [("a", 0, "meta", 22, "hot_archive", None)], "bucket of another list"),
        ("live", [("a", 0, "meta", 10, None, None), ("a", 1, "init", "x", "account", 1)], "init before protocol 11"),
        ("live", [("a", 0, "init", "x", "account", 1)], "init before protocol 11"),
        ("live", [("a", 0, "archived", "x", "account", 1)], "unknown kind"),
        ("live", [("a", 0, None, "x", "account", 1)], "unknown kind"),
        ("hot_archive", [("a", 0, "archived", "x", "account", 1)], "no meta first"),
        ("hot_archive", [("a", 0, "meta", 23, None, None)], "no list named"),
        ("hot_archive", [("a", 0, "meta", 23, "live", None)], "bucket of another list"),
        ("hot_archive", [("a", 0, "meta", 23, "hot_archive", None), ("a", 1, "dead", "x", "account", 1)], "unknown kind"),
        ("live", [("a", 0, "meta", 11, None, None), ("a", 1, "init", "x", "account", 1)], None),
    ],
)
def test_what_buckets_may_hold(spark, kind, rows, fault):
    found = buckets.record_faults(records(spark, rows), list_kind=kind).collect()
    assert [r["fault"] for r in found] == [fault]
    scan = buckets.live_entries if kind == "live" else buckets.archived_entries
    left = scan(records(spark, rows), buckets.listed(state(spark, ("a", "")), sequence=63))
    if fault is None:
        assert left.count() == 1
    else:
        with pytest.raises(Exception, match=f"{fault} at record"):
            left.collect()


def test_a_bucket_that_is_missing(spark):
    rows = records(spark, [("a", 0, "live", "x", "account", 1)])
    with pytest.raises(Exception, match="no bucket b"):
        buckets.live_entries(rows, buckets.listed(state(spark, ("a", "b")), sequence=63)).collect()


def test_histories_by_ledger_and_checkpoint(spark, tmp_path):
    path = str(tmp_path / "headers")
    rows = spark.range(0, 200_000, 7).select(F.col("id").alias("sequence"), (F.col("id") * 2).alias("v"))
    history.write(rows.where("sequence >= 100000"), path)
    history.write(rows.where("sequence < 100000"), path)
    table = history.read(spark, path)
    assert history.at(table, 70_000)["v"] == 140_000
    with pytest.raises(LookupError):
        history.at(table, 70_001)
    assert [r["sequence"] for r in history.checkpoint(table, 127).orderBy("sequence").collect()] == list(range(70, 128, 7))
    assert [r["sequence"] for r in history.checkpoint(table, 63).orderBy("sequence").collect()] == list(range(0, 64, 7))
    with pytest.raises(ValueError, match="checkpoint"):
        history.checkpoint(table, 64)
    plan = history.between(table, 70_000, 70_010)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cast(block" in plan or "PartitionFilters: [isnotnull(block" in plan
    wanted = spark.createDataFrame([(1, 14), (2, 15), (3, 199_997), (4, None)], "id int, ledger long")
    assert sorted(map(tuple, history.at_each(table, wanted, ledger="ledger").select("id", "v").collect())) == [(1, 28), (2, None), (3, 399_994 if 199_997 % 7 == 0 else None), (4, None)]
    points = spark.createDataFrame([(127,), (127,), (191,)], "point long")
    assert history.of_checkpoints(table, points, point="point").count() == len(range(70, 192, 7))


META = "k int, meta struct<version:int,contract:struct<events:array<string>,diagnostics:array<string>>,events:array<string>,operations:array<struct<events:array<string>>>,diagnostics:array<string>>"


def test_events_by_version(spark):
    part, four = (["c"], ["d"]), (["t"], [(["a", "b"],), (None,), (["x"],)], ["g"])
    rows = spark.createDataFrame([(1, (3, part, None, None, None)), (2, (3, None, ["t"], None, None)), (3, (4, part, *four)), (4, (2, part, *four)), (5, (4, None, None, None, None))], META)
    found = {r["k"]: tuple(r["e"]) for r in rows.select("k", flatten.meta_events(F.col("meta")).alias("e")).collect()}
    assert found[1] == ([], [["c"]], ["d"])
    assert found[2] == found[4] == found[5] == ([], [], [])
    assert found[3] == (["t"], [["a", "b"], [], ["x"]], ["g"])
    gated = {r["k"]: tuple(r["e"]) for r in rows.select("k", flatten.meta_events(F.col("meta"), contract=F.lit(None).cast("boolean")).alias("e")).collect()}
    assert gated[1] == ([], [], []) and gated[3] == found[3]
    listed = flatten.event_rows(rows.where("k = 3").withColumn("events", flatten.meta_events(F.col("meta"))), keep=["k"])
    assert sorted(map(str, (tuple(r) for r in listed.collect()))) == sorted(map(str, [(3, "transaction", None, 0, "t"), (3, "operation", 1, 0, "a"), (3, "operation", 1, 1, "b"), (3, "operation", 3, 0, "x"), (3, "diagnostic", None, 0, "g")]))
    with pytest.raises(Exception, match="meta of version 5"):
        spark.createDataFrame([(1, (5, None, None, None, None))], META).select(flatten.meta_events(F.col("meta"))).collect()


def test_operations_that_results_list(spark):
    rows = [("success", [1, 2], None, None, 2), ("failed", [], None, None, 0), ("failed", None, None, None, 0), ("fee_bump_inner_failed", [1], "failed", [1, 2, 3], 3), ("fee_bump_inner_success", [1], "bad_sequence", [1], 0), ("internal_error", [1], None, None, 0), (None, [1], None, None, 0)]
    df = spark.createDataFrame(rows, "code string, r array<int>, inner string, i array<int>, expected int")
    assert df.where(fees.operation_count(F.col("code"), F.col("r"), F.col("inner"), F.col("i")) != F.col("expected")).count() == 0


def test_entries_in_normal_form(spark):
    one = spark.range(1)
    line = lambda b, uses: F.struct(F.lit(7).alias("balance"), F.lit(b).cast("long").alias("buying_liabilities"), F.lit(uses).cast("int").alias("pool_use_count"))
    fields = ["balance", "buying_liabilities", "pool_use_count"]
    null = F.lit(None).cast("struct<balance:int,buying_liabilities:bigint,pool_use_count:int>")
    found = one.select(*[projections.entry_changed(a, b, fields, "trustline").alias(n) for n, a, b in [("same", line(None, 1), line(0, 2)), ("more", line(None, 1), line(1, 1)), ("new", null, line(0, 1))]]).first()
    assert tuple(found) == (False, True, True)
    signers = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(w).alias("weight")) for k, w in (("b", 2), ("a", 1))])
    entry = F.struct(projections.sponsored_signers(signers, F.array(F.lit("s"))).alias("signers"), F.lit(None).cast("int").alias("num_sponsored"))
    found = one.select(projections.normal_entry(entry, ["signers", "num_sponsored"], "account").alias("e")).first()["e"]
    assert [tuple(s) for s in found["signers"]] == [("a", 1, None), ("b", 2, "s")] and found["num_sponsored"] == 0


def test_refused_requests(spark):
    pages = [(5, None, None, None), (0, None, None, "start not known"), (None, "c", 10, None), (5, "c", 10, "start and cursor"), (5, "", 11, "limit too high"), (9, None, 10, None), (10, None, 10, "start not known"), (None, "c", 11, "limit too high")]
    df = spark.createDataFrame(pages, "start long, cursor string, n int, expected string")
    fault = paging.page_fault(start=F.col("start"), cursor=F.col("cursor"), limit=F.col("n"), oldest=F.lit(2), latest=F.lit(9), max_limit=10)
    assert df.where(~fault.eqNullSafe(F.col("expected"))).count() == 0
    queries = [
        (None, 1, None, None, None, None, None), (None, None, None, None, None, None, "no first ledger"), (None, None, 9, "desc", None, None, None), (None, 3, 2, None, None, None, "empty range"),
        (None, 3, 3, "asc", 256, 1000, None), (None, 3, 3, "up", None, None, "order"), (None, 1, None, None, 0, None, "filters"), (None, 1, None, None, 257, None, "filters"),
        ("c", None, None, "", None, 5, None), ("c", 1, None, None, None, None, "cursor and range"), ("c", None, None, None, 0, None, "cursor and range"), ("c", None, None, None, None, 0, "limit"), (None, 1, None, None, None, 1001, "limit"),
    ]
    df = spark.createDataFrame(queries, "cursor string, low long, high long, way string, filters int, n int, expected string")
    col = F.col
    fault = event_filters.query_fault(cursor=col("cursor"), first=col("low"), last=col("high"), order=col("way"), n_filters=col("filters"), limit=col("n"), max_limit=5000)
    assert df.where(~fault.eqNullSafe(col("expected"))).count() == 0
