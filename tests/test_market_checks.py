from decimal import Decimal

from pyspark.sql import functions as F

from tallyloom.operators import markets


def test_asset_report(spark):
    lines = spark.createDataFrame([("A", "authorized", 5), ("A", "maintain", 7), ("A", "other", 9), (None, "authorized", 1), ("native", "authorized", 1), ("A", None, 3)], "asset string, status string, balance long")
    claimables = spark.createDataFrame([("A", 2), ("B", None)], "asset string, amount long")
    pools = spark.createDataFrame([("A", "B", 10, 20), ("native", "B", 1, 2)], "asset_a string, asset_b string, reserve_a long, reserve_b long")
    contracts = spark.createDataFrame([("C", Decimal(10**30)), ("C", Decimal(10**30))], "asset string, amount decimal(38,0)")
    got = {r.asset: r.asDict() for r in markets.asset_report(lines, claimables, pools, contracts).collect()}
    assert set(got) == {"A", "B", "C"}
    assert (got["A"]["n_authorized"], int(got["A"]["amount_authorized"]), got["A"]["n_claimable"], int(got["A"]["amount_pool"])) == (1, 5, 1, 10)
    assert (got["B"]["n_claimable"], int(got["B"]["amount_claimable"]), got["B"]["n_pool"], int(got["B"]["amount_pool"])) == (1, 0, 2, 22)
    assert (got["C"]["n_contract"], int(got["C"]["amount_contract"]), got["C"]["n_authorized"]) == (2, 2 * 10**30, 0)
    none = [x.where("false") for x in (lines, claimables, pools, contracts)]
    assert markets.asset_report(*none).collect() == []


def test_counter_faults(spark):
    stated = spark.createDataFrame([(1, 5, 2), (2, 0, 0), (3, 1, 1), (4, None, 1)], "k long, ops long, good long")
    counted = spark.createDataFrame([(1, 5, 3), (3, 1, 1), (4, 2, 1), (5, 1, 0)], "k long, ops long, good long")
    got = sorted(map(tuple, markets.counter_faults(stated, counted, keys=["k"], counters=["ops", "good"]).collect()), key=str)
    assert got == sorted([(1, "good", 2, 3), (4, "ops", None, 2), (5, "ops", None, 1), (5, "good", None, 0)], key=str)


def test_pool_and_level_faults(spark):
    kind = "pool_id string, asset_a string, asset_b string, reserve_a long, reserve_b long, fee_bps int"
    sound = [("1", "A", "B", 1, 0, 30), ("2", "A", "C", 5, 5, 30)]
    assert markets.pool_faults(spark.createDataFrame(sound, kind)).collect() == []
    bad = [*sound, ("3", "B", "A", 1, 1, 30), ("4", "X", "Y", -1, 1, 30), ("5", "X", "Z", 1, None, None), ("2", "Q", "R", 1, 1, 30), ("6", None, "R", 1, 1, 30)]
    got = sorted(map(tuple, markets.pool_faults(spark.createDataFrame(bad, kind)).collect()))
    assert got == sorted([("3", "order of assets"), ("1", "several pools of a pair"), ("4", "reserve"), ("5", "reserve"), ("5", "fee"), ("2", "several pools"), ("6", "order of assets")])
    offers = spark.createDataFrame([("x", "y", 5, 1, 2), ("x", "y", 6, 2, 4), ("x", "z", 7, 3, 1)], "selling string, buying string, amount long, n int, d int")
    levels = spark.createDataFrame([("x", "y", 1, 2, 2, 11), ("x", "z", 3, 1, 1, 7)], "selling string, buying string, n long, d long, offers long, amount long")
    assert markets.level_faults(offers, levels).collect() == []
    off = levels.withColumn("amount", F.when(F.col("n") == 1, 12).otherwise(F.col("amount"))).unionByName(spark.createDataFrame([("q", "r", 1, 1, 1, 1)], levels.schema)).where("n <> 3")
    got = sorted((r.selling, r.buying, r.made_offers, r.held_offers) for r in markets.level_faults(offers, off).where("buying <> 'z'").collect())
    assert [g[:2] for g in got] == [("q", "r"), ("x", "y")] and markets.level_faults(offers, off).count() == 3
