from types import SimpleNamespace

from tallyloom.plans import catalog

LINES = [(1, k, 1, 2, 30.0 + k) for k in (1, 3, 5, 7)] + [(20_000, 4, 3, 4, 9.0)]


def tables(spark):
    lines = spark.createDataFrame(LINES, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    return SimpleNamespace(spark=spark, lineitem=lines)


def test_offers_hold_all_lines(spark):
    assert catalog._offers(tables(spark)).count() == len(LINES)
    assert {(r.selling, r.cost) for r in catalog.q48b(tables(spark)).collect()} == {("a1", 31 + 18), ("a3", None)}  # 31 at 2/2, 9 of 33 at 4/2


def test_missing_files_reach_the_last_checkpoint(spark):
    missing = {(r.category, r.checkpoint) for r in catalog.q33b(tables(spark)).collect()}
    last = 20_000 // 64 * 64 + 63
    grid = range(63, last + 1, 64)
    assert missing == {(c, g) for c in ("ledger", "results", "transactions") for g in grid} - {("results", 63), ("ledger", 63), ("transactions", 63), ("results", last)}
