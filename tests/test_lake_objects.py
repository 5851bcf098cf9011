import pytest
from pyspark.sql import functions as F

from tallyloom.operators import flatten, markets
from tallyloom.sources import lake


def test_a_manifest_is_made_once_and_then_checked(spark, tmp_path):
    folder = f"file://{tmp_path}"
    config = {"networkPassphrase": "a net", "version": "1", "compression": "zstd", "ledgersPerBatch": 1, "batchesPerPartition": 64000}
    assert lake.read_manifest(spark, folder) is None
    with pytest.raises(ValueError, match="above 0"):
        lake.publish_manifest(spark, folder, {"version": "1"})
    with pytest.raises(ValueError, match="above 0"):
        lake.load_schema(spark, folder, {})
    assert lake.load_schema(spark, folder, config) == {"ledgersPerBatch": 1, "batchesPerPartition": 64000}
    assert lake.publish_manifest(spark, folder, config) == (config, True)
    assert lake.publish_manifest(spark, folder, config) == (config, False)
    assert lake.publish_manifest(spark, folder, {"version": "1", "ledgersPerBatch": 0}) == (config, False)
    with pytest.raises(ValueError, match="ledgersPerBatch: 2 here, 1 there"):
        lake.publish_manifest(spark, folder, config | {"ledgersPerBatch": 2})
    assert lake.load_schema(spark, folder, {"ledgersPerBatch": 7}) == {"ledgersPerBatch": 1, "batchesPerPartition": 64000}


def test_metadata_numbers(spark):
    df = spark.createDataFrame([({"start-ledger": "5", "version": "x"},), ({},)], "m map<string,string>")
    rows = [r[0] for r in df.select(lake.object_metadata(F.col("m"))).collect()]
    assert [(r.start_ledger, r.end_ledger, r.version) for r in rows] == [(5, None, "x"), (None, None, None)]
    for bad in ("x", "-1", "4294967296"):
        with pytest.raises(Exception, match="start-ledger|CAST_INVALID_INPUT"):
            spark.createDataFrame([({"start-ledger": bad},)], "m map<string,string>").select(lake.object_metadata(F.col("m"))).collect()


def test_envelopes_of_odd_sets(spark):
    kind = "s struct<txs:array<string>,phases:array<struct<components:array<struct<txs:array<string>>>,stages:array<array<array<string>>>>>>"
    sets = [((["a"], None),), ((None, [([(["b"],), (None,)], None), (None, None), (None, [[["c"], None], None, [["d", "e"]]])]),), ((None, []),)]
    assert [r[0] for r in spark.createDataFrame(sets, kind).select(flatten.envelopes(F.col("s"))).collect()] == [["a"], ["b", "c", "d", "e"], []]


def test_transactions_are_matched_without_a_shuffle(spark):
    kind = "sequence long, protocol int, envelopes array<struct<hash:string,source:string>>, processing array<struct<hash:string,result_code:string>>"
    df = spark.createDataFrame([(1, 23, [("b", "B"), ("a", "A"), ("z", "Z")], [("a", "success"), ("b", "failed")]), (2, 23, [], [])], kind)
    out = flatten.transactions(df)
    assert [(r.ledger, r.tx_index, r.hash, r.asked.source, r.done.result_code) for r in out.collect()] == [(1, 1, "a", "A", "success"), (1, 2, "b", "B", "failed")]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_sound_book_has_no_faults(spark):
    kind = "offer_id long, selling string, buying string, amount long, n int, d int"
    sound = [(1, "x", "y", 5, 1, 2), (2, "y", "x", 5, 2, 1)]
    assert markets.book_faults(spark.createDataFrame(sound, kind)).count() == 0
    faulty = [(1, "x", "y", 5, 1, 2), (1, "x", "y", 5, 1, 2), (3, "x", "x", 0, 1, 2), (4, None, None, None, 1, 0)]
    assert sorted(tuple(r) for r in markets.book_faults(spark.createDataFrame(faulty, kind)).collect()) == [(1, "several offers"), (3, "amount"), (3, "same asset"), (4, "amount"), (4, "price"), (4, "same asset")]
