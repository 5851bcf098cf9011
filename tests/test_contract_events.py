import hashlib
import json

import pytest
from plain_address import encode_one
from pyspark.sql import functions as F

from tallyloom.functions import address, contract_values as cv, derived_ids as ids
from tallyloom.operators.contract_data import asset_rows, balance_rows
from tallyloom.operators.contract_events import asset_events, fee_events, read_events, token_movements

C = F.col
NET = hashlib.sha256(b"a network").digest()
KEYS = {n: hashlib.sha256(n.encode()).digest() for n in ("alice", "bob", "issuer", "token")}
ACCOUNT = {n: encode_one(address.VERSIONS["account"], k) for n, k in KEYS.items()}
MUXED = {n: encode_one(address.VERSIONS["muxed"], k + (7).to_bytes(8, "big")) for n, k in KEYS.items()}
CONTRACT = encode_one(address.VERSIONS["contract"], KEYS["token"])
USD = f"USD:{ACCOUNT['issuer']}"


def asset_xdr(code, issuer):
    if code is None:
        return b"\0" * 4
    wide = len(code) > 4
    return (2 if wide else 1).to_bytes(4, "big") + code.encode().ljust(12 if wide else 4, b"\0") + b"\0" * 4 + issuer


def contract_of(code, issuer=KEYS["issuer"]):
    return hashlib.sha256((8).to_bytes(4, "big") + NET + (1).to_bytes(4, "big") + asset_xdr(code, issuer)).digest()


def sym(x):
    return {"symbol": x}


def adr(x):
    return {"address": x}


def text(x):
    return {"string": x}


def i128(x):
    return {"i128": str(x)}


def data_map(*pairs):
    return {"map": [{"key": sym(k) if isinstance(k, str) else k, "val": v} for k, v in pairs]}


def event_frame(spark, rows):
    """rows: (meta_version, topics, data, overrides)."""
    out = []
    for i, (meta, topics, data, *more) in enumerate(rows):
        over = {"type": "contract", "contract": KEYS["token"], "body_version": 0} | (more[0] if more else {})
        out.append((i // 3, 1, i, meta, over["type"], None if over["contract"] is None else bytearray(over["contract"]), over["body_version"], None if topics is None else [json.dumps(t) for t in topics], None if data is None else json.dumps(data)))
    df = spark.createDataFrame(out, "ledger int, tx_index int, op_index int, meta_version int, type string, contract binary, body_version int, topics array<string>, data string")
    return df.withColumn("topics", F.transform("topics", cv.parsed)).withColumn("data", cv.parsed(C("data")))


A, B, I = adr(ACCOUNT["alice"]), adr(ACCOUNT["bob"]), adr(ACCOUNT["issuer"])
SAC = {"contract": contract_of("USD")}
NATIVE = {"contract": contract_of(None)}
CASES = [
    # an unknown token's events, both versions
    ((3, [sym("transfer"), A, B], i128(5)), ("transfer", "alice", "bob", "5", None, None)),
    ((3, [sym("transfer"), A, B, text("anything"), text("more")], i128(5)), ("transfer", "alice", "bob", "5", None, None)),
    ((3, [sym("transfer"), A], i128(5)), "too few topics"),
    ((3, [sym("mint"), A, B], i128(5)), ("mint", None, "bob", "5", None, None)),
    ((3, [sym("mint"), text("no address"), B], i128(5)), "address"),
    ((3, [sym("mint"), A], i128(5)), "too few topics"),
    ((4, [sym("mint"), A], i128(5)), ("mint", None, "alice", "5", None, None)),
    ((3, [sym("clawback"), A, B], i128(5)), ("clawback", "bob", None, "5", None, None)),
    ((4, [sym("clawback"), A, B], i128(5)), ("clawback", "alice", None, "5", None, None)),
    ((3, [sym("burn"), A], i128(5)), ("burn", "alice", None, "5", None, None)),
    ((4, [sym("burn"), A], i128(2**127 - 1)), ("burn", "alice", None, str(2**127 - 1), None, None)),
    ((4, [sym("transfer"), adr(CONTRACT), adr(MUXED["bob"])], i128(-5)), ("transfer", CONTRACT, MUXED["bob"], "-5", None, None)),
    # what is no token movement
    ((3, [sym("transfer"), A, B], {"u64": "5"}), "amount"),
    ((3, [sym("transfer"), A, B], data_map(("amount", i128(5)))), "amount"),
    ((4, [sym("approve"), A, B], i128(5)), "other name"),
    ((4, [text("transfer"), A, B], i128(5)), "no name"),
    ((4, [sym("transfer")], i128(5)), "too few topics"),
    ((5, [sym("transfer"), A, B], i128(5)), "meta version"),
    ((4, [sym("transfer"), adr("GBROKEN"), B], i128(5)), "address"),
    ((4, [sym("transfer"), A, B], i128(5), {"type": "system"}), "no contract event"),
    ((4, [sym("transfer"), A, B], i128(5), {"contract": None}), "no contract event"),
    ((4, [sym("transfer"), A, B], i128(5), {"body_version": 1}), "no contract event"),
    ((4, None, i128(5)), "too few topics"),
    ((4, [sym("transfer"), A, B], None), "amount"),
    # data of version 4
    ((4, [sym("transfer"), A, B], data_map(("amount", i128(9)), ("to_muxed_id", {"u64": "18446744073709551615"}))), ("transfer", "alice", "bob", "9", None, ("id", "18446744073709551615"))),
    ((4, [sym("transfer"), A, B], data_map(("to_muxed_id", {"bytes": "0aff"}), ("amount", i128(9)))), ("transfer", "alice", "bob", "9", None, ("hash", "0aff"))),
    ((4, [sym("transfer"), A, B], data_map(("amount", i128(9)), ("to_muxed_id", text("memo")), ("other", {"bool": True}))), ("transfer", "alice", "bob", "9", None, ("text", "memo"))),
    ((4, [sym("transfer"), A, B], data_map(("amount", i128(9)), ("to_muxed_id", {"void": None}))), ("transfer", "alice", "bob", "9", None, None)),
    ((4, [sym("transfer"), A, B], data_map(("amount", i128(9)), ("to_muxed_id", {"bool": True}))), "to_muxed_id"),
    ((4, [sym("transfer"), A, B], data_map(("to_muxed_id", text("memo")))), "no amount"),
    ((4, [sym("transfer"), A, B], data_map(("amount", {"u64": "9"}))), "amount"),
    ((4, [sym("transfer"), A, B], data_map(("amount", i128(9)), (text("x"), text("y")))), "key type"),
    ((4, [sym("transfer"), A, B], {"map": None}), "map is empty"),
    # assets that are proven, and ones that are only claimed
    ((4, [sym("transfer"), A, B, text(USD)], i128(5), SAC), ("transfer", "alice", "bob", "5", USD, None)),
    ((4, [sym("transfer"), A, B, text(USD)], i128(5)), ("transfer", "alice", "bob", "5", None, None)),
    ((4, [sym("transfer"), A, B, text(USD), text("x")], i128(5), SAC), ("transfer", "alice", "bob", "5", None, None)),
    ((4, [sym("mint"), A, text(USD)], i128(5), SAC), ("mint", None, "alice", "5", USD, None)),
    ((3, [sym("mint"), I, A, text(USD)], i128(5), SAC), ("mint", None, "alice", "5", USD, None)),
    ((4, [sym("transfer"), A, B, text("native")], i128(5), NATIVE), ("transfer", "alice", "bob", "5", "native", None)),
    ((4, [sym("transfer"), A, B, text("native")], i128(5), SAC), ("transfer", "alice", "bob", "5", None, None)),
    ((4, [sym("transfer"), A, B, text("USD:nobody")], i128(5), SAC), ("transfer", "alice", "bob", "5", None, None)),
    ((4, [sym("transfer"), A, B, text("")], i128(5), SAC), ("transfer", "alice", "bob", "5", None, None)),
    # version 3 writes mints and burns as transfers
    ((3, [sym("transfer"), I, B, text(USD)], i128(5), SAC), ("mint", None, "bob", "5", USD, None)),
    ((3, [sym("transfer"), B, I, text(USD)], i128(5), SAC), ("burn", "bob", None, "5", USD, None)),
    ((3, [sym("transfer"), I, I, text(USD)], i128(5), SAC), ("transfer", "issuer", "issuer", "5", USD, None)),
    ((3, [sym("transfer"), A, adr(MUXED["issuer"]), text(USD)], i128(5), SAC), ("burn", "alice", None, "5", USD, None)),
    ((3, [sym("transfer"), A, adr(MUXED["bob"]), text(USD)], i128(5), SAC), ("transfer", "alice", "bob", "5", USD, None)),
    ((4, [sym("transfer"), I, B, text(USD)], i128(5), SAC), ("transfer", "issuer", "bob", "5", USD, None)),
    ((3, [sym("transfer"), I, B, text(USD)], i128(5)), ("transfer", "issuer", "bob", "5", None, None)),
]


def test_each_rule_of_token_events(spark):
    events = event_frame(spark, [case for case, _ in CASES]).withColumn("__data", F.lit(1)).withColumn("a.b", F.lit(2))
    rows = sorted(read_events(events, network=F.lit(bytearray(NET))).collect(), key=lambda r: r.op_index)
    names = {v: k for k, v in ACCOUNT.items()}
    for (_, want), r in zip(CASES, rows, strict=True):
        got = r.wrong or (r.kind, names.get(r.source, r.source), names.get(r.target, r.target), r.amount, r.asset, r.mark and tuple(r.mark))
        assert got == want, (r.op_index, got, want)
        assert not r.wrong or (r.kind, r.source, r.amount, r.asset, r.mark) == (None,) * 5
    kept = token_movements(events, network=F.lit(bytearray(NET)))
    assert kept.count() == sum(not isinstance(w, str) for _, w in CASES) and {"a.b", "contract"} <= set(kept.columns)
    plan = kept._jdf.queryExecution().toString()
    assert "Exchange" not in plan


SAC_CASES = [
    ((3, [sym("transfer"), A, B, text(USD)], i128(5), SAC), ("ok", "transfer", "alice", "bob", "5", USD)),
    ((3, [sym("mint"), I, B, text(USD)], data_map(("x", i128(1)), ("amount", i128(5))), SAC), ("ok", "mint", "issuer", "bob", "5", USD)),
    ((3, [sym("clawback"), I, B, text(USD)], i128(5), SAC), ("ok", "clawback", "issuer", "bob", "5", USD)),
    ((3, [sym("burn"), A, text(USD)], i128(5), SAC), ("ok", "burn", "alice", None, "5", USD)),
    ((3, [sym("burn"), A, text(USD)], data_map(("amount", i128(5))), SAC), "invalid"),
    ((3, [sym("burn"), A, B, text(USD)], i128(5), SAC), "invalid"),
    ((3, [sym("mint"), B, text(USD)], i128(5), SAC), "invalid"),
    ((3, [sym("transfer"), A, text("x"), text(USD)], i128(5), SAC), "invalid"),
    ((3, [sym("transfer"), A, B, text(USD)], {"u64": "5"}, SAC), "invalid"),
    ((3, [sym("transfer"), A, B, text(USD)], i128(5)), "integrity"),
    ((3, [sym("transfer"), A, B, text("native")], i128(5), NATIVE), ("ok", "transfer", "alice", "bob", "5", "native")),
    ((3, [sym("transfer"), A, B, text("Native")], i128(5), NATIVE), "not an asset contract"),
    ((3, [sym("transfer"), A, B, text("")], i128(5), SAC), "not an asset contract"),
    ((3, [sym("transfer"), text(USD)], i128(5), SAC), "not an asset contract"),
    ((3, [sym("approve"), A, B, text(USD)], i128(5), SAC), "not an asset contract"),
    ((3, [sym("transfer"), A, B, text("THIRTEENBYTES:" + ACCOUNT["issuer"])], i128(5), SAC), "not an asset contract"),
    ((3, [sym("transfer"), A, B, text(USD)], i128(5), SAC | {"type": "diagnostic"}), "not an asset contract"),
    ((3, None, None, {"contract": None}), "not an asset contract"),
]


def test_each_rule_of_asset_contract_events(spark):
    rows = sorted(asset_events(event_frame(spark, [c for c, _ in SAC_CASES]), network=F.lit(bytearray(NET))).collect(), key=lambda r: r.op_index)
    names = {v: k for k, v in ACCOUNT.items()}
    for (_, want), r in zip(SAC_CASES, rows, strict=True):
        got = (r.verdict, r.kind, names.get(r.first), names.get(r.second), r.amount, r.asset) if r.verdict == "ok" else r.verdict
        assert got == want, (r.op_index, got, want)


FEES = [
    ("one", [([sym("fee"), A], i128(10), NATIVE)], [("alice", "10")]),
    ("two", [([sym("fee"), A], i128(10), NATIVE), ([sym("fee"), A], i128(-3), NATIVE), ([sym("other")], i128(1), SAC)], [("alice", "-3"), ("alice", "10")]),
    ("three", [([sym("fee"), A], i128(k), NATIVE) for k in range(3)], "too many fees"),
    ("none", [([text("fee"), A], i128(10), NATIVE)], "no fee"),
    ("topics", [([sym("fee"), A, B], i128(10), NATIVE)], "topics"),
    ("amount", [([sym("fee"), A], {"u64": "1"}, NATIVE)], "amount"),
    ("address", [([sym("fee"), sym("x")], i128(10), NATIVE)], "address"),
    ("contract", [([sym("fee"), A], i128(10), SAC), ([sym("fee"), A], i128(10), NATIVE)], "contract"),
    ("format", [([sym("fee"), A], i128(10), NATIVE), ([sym("x")], i128(10), NATIVE | {"type": "system"})], "format"),
]


def test_fee_events(spark):
    frames = [event_frame(spark, [(4, *e) for e in events]).withColumn("ledger", F.lit(i)) for i, (_, events, _) in enumerate(FEES)]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    net = F.lit(bytearray(NET))
    rows = fee_events(whole, network=net, on_error="mark").collect()
    names = {v: k for k, v in ACCOUNT.items()}
    for i, (label, _, want) in enumerate(FEES):
        own = [r for r in rows if r.ledger == i]
        got = own[0].wrong if own[0].wrong else sorted((names[r.source], r.amount) for r in own)
        assert got == want and (isinstance(want, list) or len(own) == 1), label
    assert fee_events(frames[0].unionByName(frames[1]), network=net).count() == 3
    with pytest.raises(Exception, match="too many fees"):
        fee_events(frames[2], network=net).collect()


def entry_frame(spark, rows):
    made = [(i, None if c is None else bytearray(c), d, None if k is None else json.dumps(k), None if v is None else json.dumps(v)) for i, (c, d, k, v) in enumerate(rows)]
    df = spark.createDataFrame(made, "i int, contract binary, durability string, key string, val string")
    return df.withColumn("key", cv.parsed(C("key"))).withColumn("val", cv.parsed(C("val")))


def test_each_rule_of_asset_entries(spark):
    key, P = {"ledger_key_contract_instance": None}, "persistent"

    def instance(code="USD", issuer=KEYS["issuer"].hex(), name="AlphaNum4", info="AssetInfo", more=(), order=True, code_kind="string", first=()):
        pairs = [("asset_code", {code_kind: code}), ("issuer", {"bytes": issuer}), *more]
        value = {"vec": [sym(name), data_map(*(pairs if order else pairs[::-1]))]}
        return {"instance": {"executable": "stellar_asset", "storage": [*first, {"key": {"vec": [sym("Admin")]}, "val": A}, {"key": {"vec": [sym(info)]}, "val": value}]}}

    usd = contract_of("USD")
    long_code = contract_of("EURO12345678")
    empty_first = {"key": {"vec": [sym("AssetInfo")]}, "val": {"void": None}}
    cases = [
        ((usd, P, key, instance()), ("USD", KEYS["issuer"])),
        ((long_code, P, key, instance("EURO12345678", name="AlphaNum12")), ("EURO12345678", KEYS["issuer"])),
        ((long_code, P, key, instance()), None),  # forged
        ((contract_of(None), P, key, instance()), None),
        ((usd, "temporary", key, instance()), None),
        ((usd, P, {"ledger_key_nonce": "1"}, instance()), None),
        ((usd, P, key, instance(info="Other")), None),
        ((usd, P, key, instance(name="Native")), None),
        ((usd, P, key, instance(order=False)), None),
        ((usd, P, key, instance(more=[("x", A)])), None),
        ((usd, P, key, instance(code="")), None),
        ((usd, P, key, instance(code_kind="symbol")), None),
        ((usd, P, key, instance(issuer="ab")), None),
        ((usd, P, key, instance(issuer="xy")), None),
        ((usd, P, key, instance(first=[empty_first])), None),
        ((usd, P, key, {"instance": {"executable": "stellar_asset", "storage": None}}), None),
        ((usd, P, key, {"void": None}), None),
        ((None, P, key, instance()), None),
        ((usd, None, key, instance()), None),
        ((usd, P, None, instance()), None),
        ((usd, P, key, None), None),
    ]
    got = {r.i: (r.code, bytes(r.issuer)) for r in asset_rows(entry_frame(spark, [c for c, _ in cases]), network=F.lit(bytearray(NET))).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases) if w}


def test_each_rule_of_balance_entries(spark):
    P, usd = "persistent", contract_of("USD")
    holder = adr(CONTRACT)
    key = lambda who=holder, name="Balance", more=(): {"vec": [sym(name), who, *more]}
    value = lambda amount=i128(2**100), auth={"bool": True}, claw={"bool": False}, names=("amount", "authorized", "clawback"), more=(): data_map(*zip(names, (amount, auth, claw), strict=True), *more)
    cases = [
        ((usd, P, key(), value()), str(2**100)),
        ((usd, P, key(), value(i128(0))), "0"),
        ((usd, P, key(), value(i128(-1))), None),
        ((usd, P, key(), value({"u64": "1"})), None),
        ((usd, P, key(A), value()), None),  # an account holds trust lines
        ((usd, P, key(text("x")), value()), None),
        ((usd, P, key(name="Allowance"), value()), None),
        ((usd, P, key(more=[A]), value()), None),
        ((usd, P, {"vec": None}, value()), None),
        ((usd, P, sym("Balance"), value()), None),
        ((usd, P, key(), value(names=("amount", "clawback", "authorized"))), None),
        ((usd, P, key(), value(auth={"u32": 1})), None),
        ((usd, P, key(), value(claw={"void": None})), None),
        ((usd, P, key(), value(more=[("x", A)])), None),
        ((usd, P, key(), {"map": None}), None),
        ((usd, "temporary", key(), value()), None),
        ((contract_of(None), P, key(), value()), None),
        ((None, P, key(), value()), None),
        ((usd, P, None, None), None),
    ]
    got = {r.i: (r.holder, r.amount) for r in balance_rows(entry_frame(spark, [c for c, _ in cases]), network=F.lit(bytearray(NET))).collect()}
    assert got == {i: (CONTRACT, w) for i, (_, w) in enumerate(cases) if w}


VALUES = [
    ({"bool": True}, "true"),
    ({"void": None}, "(void)"),
    ({"u32": 7}, "7"),
    ({"i256": "-" + "9" * 60}, "-" + "9" * 60),
    ({"bytes": "0aff"}, "0aff"),
    ({"string": 'a "b" c'}, 'a "b" c'),
    ({"vec": None}, "nil"),
    ({"vec": []}, "[]"),
    ({"vec": [{"symbol": "a"}, {"vec": [{"u32": 1}, {"u32": 2}]}]}, "[a [1 2]]"),
    ({"map": None}, "nil"),
    ({"map": [{"key": {"symbol": "k"}, "val": {"i128": "5"}}, {"key": {"u32": 1}, "val": {"map": []}}]}, "[{k 5} {1 []}]"),
    ({"map": [{"key": {"u32": 1}, "val": {"map": []}}, {"key": {"symbol": "k"}, "val": {"i128": "5"}}]}, "[{1 []} {k 5}]"),
    ({"address": CONTRACT}, CONTRACT),
    ({"ledger_key_contract_instance": None}, "(LedgerKeyContractInstance)"),
    ({"instance": {"executable": "stellar_asset", "storage": [{"key": {"symbol": "a"}, "val": {"u32": 1}}]}}, "(StellarAssetContract): [{a 1}]"),
    ({"instance": {"executable": {"wasm": "ab"}, "storage": None}}, "ab"),
    ({"error": {"contract": 3}}, "contract(3)"),
    ([1], "unknown"),
]


def test_equality_and_text_of_values(spark):
    spaced = lambda v: json.dumps(v, indent=1)
    rows = [(i, j, json.dumps(a), spaced(b)) for i, (a, _) in enumerate(VALUES) for j, (b, _) in enumerate(VALUES)]
    df = spark.createDataFrame([*rows, (-1, -1, None, None)], "i int, j int, a string, b string").select("i", "j", cv.parsed(C("a")).alias("a"), cv.parsed(C("b")).alias("b"))
    got = df.select("i", "j", cv.same(C("a"), C("b")).alias("same"), cv.rendered(C("a")).alias("text")).collect()
    for r in got:
        assert (r.same, r.text) == ((None, None) if r.i < 0 else (r.i == r.j, VALUES[r.i][1]))


def test_derived_ids(spark):
    df = spark.createDataFrame([("USD", bytearray(KEYS["issuer"])), ("EUROS", bytearray(KEYS["alice"])), (None, None), ("THIRTEENBYTES", bytearray(KEYS["issuer"])), ("", bytearray(KEYS["issuer"])), ("USD", bytearray(b"short"))], "code string, issuer binary")
    net = F.lit(bytearray(NET))
    asset = ids.asset_bytes(C("code"), C("issuer"))
    rows = df.select(asset.alias("x"), ids.contract_id(asset, net).alias("id")).collect()
    wanted = [("USD", KEYS["issuer"]), ("EUROS", KEYS["alice"]), (None, None)]
    assert [bytes(r.x) for r in rows[:3]] == [asset_xdr(*w) for w in wanted] and [bytes(r.id) for r in rows[:3]] == [contract_of(*w) for w in wanted]
    assert [r.id for r in rows[3:]] == [None] * 3
    usd, eur = asset_xdr("USD", KEYS["issuer"]), asset_xdr("EUROS", KEYS["alice"])
    pair = spark.createDataFrame([(bytearray(usd), bytearray(eur)), (bytearray(eur), bytearray(usd)), (bytearray(usd), bytearray(usd))], "a binary, b binary")
    pools = [r[0] for r in pair.select(ids.pool_id(C("a"), C("b"), 30)).collect()]
    assert bytes(pools[0]) == hashlib.sha256(b"\0" * 4 + usd + eur + (30).to_bytes(4, "big")).digest() and pools[1:] == [None, None]
    whole = (7).to_bytes(4, "big") + b"\0" * 4 + KEYS["bob"] + (5).to_bytes(8, "big") + (2).to_bytes(4, "big") + bytes(pools[0]) + usd
    got = spark.range(1).select(ids.revoked_balance_id(account=F.lit(bytearray(KEYS["bob"])), sequence=F.lit(5), op_index=F.lit(2), pool=F.lit(bytes(pools[0])), asset=F.lit(usd))).first()[0]
    assert bytes(got) == hashlib.sha256(whole).digest()


def test_revoked_trust_lines(spark):
    from tallyloom.operators.revocations import revocation_movements

    x, y = bytearray(asset_xdr(None, None)), bytearray(asset_xdr("USD", KEYS["issuer"]))
    pool = lambda n: bytearray(hashlib.sha256(b"pool%d" % n).digest())
    pools = [(1, 1, n, pool(n), x, y, -5, 7) for n in range(4)] + [(1, 1, 3, pool(9), x, y, 1, 2)]
    frame = spark.createDataFrame(pools, "ledger int, tx_index int, op_index int, pool binary, asset_a binary, asset_b binary, amount_a long, amount_b long")
    txs = spark.createDataFrame([(1, 1, bytearray(KEYS["bob"]), 77)], "ledger int, tx_index int, account binary, sequence long")

    def balance(op, asset):
        whole = (7).to_bytes(4, "big") + b"\0" * 4 + KEYS["bob"] + (77).to_bytes(8, "big") + op.to_bytes(4, "big") + bytes(pool(op)) + bytes(asset)
        return bytearray(hashlib.sha256(whole).digest())

    made = [(1, 1, 1, balance(1, x), x, 50), (1, 1, 2, balance(2, y), y, 60), (1, 1, 3, balance(3, x), x, 70), (1, 1, 3, balance(3, y), y, 80), (1, 1, 0, bytearray(b"another"), x, 9)]
    schema = "ledger int, tx_index int, op_index int, balance_id binary, asset binary, amount long"
    got = revocation_movements(frame, spark.createDataFrame(made, schema), txs).collect()
    rows = sorted((r.op_index, r.leg, r.kind, None if r.target is None else bytes(r.target), bytes(r.asset), r.amount) for r in got)
    assert rows == [
        (1, 0, "transfer", bytes(made[0][3]), bytes(x), 50),
        (1, 1, "burn", None, bytes(y), 7),
        (2, 0, "transfer", bytes(made[1][3]), bytes(y), 60),
        (2, 1, "burn", None, bytes(x), 5),
        (3, 0, "transfer", bytes(made[2][3]), bytes(x), 70),
        (3, 1, "transfer", bytes(made[3][3]), bytes(y), 80),
    ]
    with pytest.raises(Exception, match="more than two balances"):
        revocation_movements(frame, spark.createDataFrame([*made, made[2]], schema), txs).collect()
