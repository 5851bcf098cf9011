import json

from pyspark.sql import functions as F

from tallyloom.functions import json_forms as jf


def test_all_types_in_one_pass(spark, tmp_path):
    rows = [(json.dumps({"id": str(k), "type_i": k, "source_account": f"s{k}", "amount": "5", "balance_id": "b", "extend_to": 7, "claimants": [{"destination": "x"}], "transaction_successful": True}),) for k in jf.OPERATIONS]
    df = spark.createDataFrame([*rows, ("no json",), (None,), ("{}",), ('{"type_i": 99}',)], "j string")
    out = jf.typed_operations(df, "j")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Exchange" not in plan
    got = {r.type_i: r for r in out.collect()}
    assert set(got) == set(jf.OPERATIONS)
    for k, r in got.items():
        assert r.id == str(k) and r.source_account == f"s{k}"
        assert all((r[c] is not None) == (c == f"own_{k}") for c in out.columns if c.startswith("own_"))
    assert got[20].own_20.balance_id == "b" and got[25].own_25.extend_to == 7 and got[14].own_14.claimants[0].destination == "x"
    out.write.partitionBy("type_i").parquet(str(tmp_path / "ops"))
    assert spark.read.parquet(str(tmp_path / "ops")).where("type_i = 20").select("own_20.balance_id").first()[0] == "b"
    for k in (1, 14, 26):
        one = jf.operation_rows(df, "j", k).collect()
        assert len(one) == 1 and one[0].type_i == k
    assert jf.operation_rows(df.where(F.lit(False)), "j", 1).collect() == []
