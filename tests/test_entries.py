import pytest

from tallyloom.operators import deltas, transfers

ENTRY = "struct<type:string,account_id:string,balance:long,asset:string,balance_id:string,amount:long,pool_id:string,asset_a:string,asset_b:string,reserve_a:long,reserve_b:long>"


def account(who, n):
    return ("account", who, n, *[None] * 8)


def line(who, asset, n):
    return ("trustline", who, n, asset, *[None] * 7)


def claimable(i, asset, n):
    return ("claimable_balance", None, None, asset, i, n, *[None] * 5)


def pool(i, a, b, x, y):
    return ("liquidity_pool", *[None] * 5, i, a, b, x, y)


def test_deltas_of_every_kind_of_entry(spark):
    rows = [
        (account("a", 5), account("a", 9)),
        (None, account("b", 1)),
        (line("a", "X", 3), None),
        (line("a", None, 3), line("a", None, 9)),  # pool shares
        (None, claimable("c", "X", 7)),
        (claimable("d", "native", 2), None),
        (pool("p", "X", "Y", 10, 20), pool("p", "X", "Y", 15, 20)),
        (pool("q", "X", "Y", 1, 2), None),
        (("offer", *[None] * 10), None),
        (None, None),
        (account("z", None), account("z", 4)),
    ]
    got = {(r.holder, r.asset): int(r.delta) for r in deltas.entry_deltas(spark.createDataFrame(rows, f"pre {ENTRY}, post {ENTRY}")).collect()}
    assert got == {("a", "native"): 4, ("b", "native"): 1, ("a", "X"): -3, ("c", "X"): 7, ("d", "native"): -2, ("p", "X"): 5, ("q", "X"): -1, ("q", "Y"): -2, ("z", "native"): 4}


def test_a_claim_removes_exactly_one_balance(spark):
    schema = "ledger int, tx_index int, op_index int, type string, kind string, balance_id string, asset string, amount long"
    gone, other = ("claimable_balance", "removed", "b", "X", 5), ("account", "updated", None, None, None)
    rows = [(1, 1, 1, *gone), (1, 1, 1, *other), (1, 1, 2, *other), (1, 1, 3, *gone), (1, 1, 3, *gone), (1, 1, 4, "claimable_balance", "created", "b", "X", 5), (1, 1, 5, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.op_index: (r.balance_id, r.amount, r.wrong) for r in transfers.claimed_balances(df, on_error="mark").collect()}
    none, many = (None, None, "no balance is removed"), (None, None, "several balances are removed")
    assert got == {1: ("b", 5, None), 2: none, 3: many, 4: none, 5: none}
    assert transfers.claimed_balances(df.where("op_index = 1")).count() == 1
    with pytest.raises(Exception, match="several balances"):
        transfers.claimed_balances(df.where("op_index = 3")).collect()
