import pytest
from pyspark.sql import functions as F

from tallyloom.operators import archives, changes, deltas, event_filters as ev, fees, flatten, paging, snapshot, transfers
from tallyloom.sinks import tables
from tallyloom.sources import lake

C = F.col
A, U, D, R = "created", "updated", "removed", "restored"


def compact(spark, steps, **more):
    rows = [(1, i, k, None if k == A else 10 * i, None if k == D else 10 * i + 1) for i, k in enumerate(steps, 1)]
    df = spark.createDataFrame(rows, "key long, ord long, kind string, pre long, post long")
    return [tuple(r)[1:] for r in changes.compacted(df, keys=["key"], order=["ord"], on_error="mark", **more).collect()]


@pytest.mark.parametrize(
    ("steps", "want"),
    [
        ([A], [(A, None, 11)]), ([U], [(U, 10, 11)]), ([D], [(D, 10, None)]), ([R], [(R, 10, 11)]),
        ([A, U], [(A, None, 21)]), ([A, D], []), ([A, A], "error"), ([A, R], "error"),
        ([U, U], [(U, 10, 21)]), ([U, D], [(D, 10, None)]), ([U, A], "error"), ([U, R], "error"),
        ([D, A], [(U, 10, 21)]), ([D, U], "error"), ([D, D], "error"), ([D, R], "error"),
        ([R, U], [(R, 10, 21)]), ([R, D], []), ([R, A], "error"), ([R, R], "error"),
        ([A, D, A], [(A, None, 31)]), ([A, A, U], "error"),
    ],
)
def test_compaction_steps(spark, steps, want):
    got = compact(spark, steps)
    assert got == want if want != "error" else got[0][0] == "error"


def test_compaction_options(spark):
    assert compact(spark, [R, D], suppress_remove_after_restore=False) == [(D, 20, None)]
    df = spark.createDataFrame([(1, 1, U, 1, 90), (1, 2, U, 90, 50)], "key long, ord long, kind string, pre long, post long")
    assert changes.compacted(df, keys=["key"], order=["ord"], longest=True).first().post == 90
    bad = spark.createDataFrame([(1, 1, A, None, 1), (1, 2, A, None, 2)], "key long, ord long, kind string, pre long, post long")
    with pytest.raises(Exception, match="not allowed"):
        changes.compacted(bad, keys=["key"], order=["ord"]).collect()


def test_newest_wins(spark):
    rows = [("a", 0, "curr", "dead", 0), ("a", 1, "curr", "live", 1), ("b", 1, "snap", "live", 2), ("b", 1, "curr", "live", 3), ("c", 3, "curr", "live", 4)]
    df = spark.createDataFrame(rows, "key string, level int, slot string, kind string, v long")
    order = [snapshot.layer_rank(C("level"), C("slot"))]
    got = snapshot.newest(df, keys=["key"], newest_first=order, dead=C("kind") == "dead")
    assert sorted(r.v for r in got.collect()) == [3, 4]
    kept = snapshot.newest(df, keys=["key"], newest_first=order, dead=C("kind") == "dead", keep=C("level") > 0)
    assert sorted(r.v for r in kept.collect()) == [1, 3, 4]
    assert snapshot.newest(df.where("false"), keys=["key"], newest_first=order, dead=C("kind") == "dead").count() == 0


def test_change_order_waits_in_parallel_phases(spark):
    rows = [(1, 1, 1, True, tx, op, part, b"k", i) for i, (tx, op, part) in enumerate([(1, None, 0), (1, 1, 1), (1, None, 2), (2, None, 0), (2, 1, 1), (2, None, 2)])]
    df = spark.createDataFrame(rows, "ledger long, stage int, phase int, parallel boolean, tx_index int, op_index int, part int, key binary, ord long")
    assert [r.ord for r in changes.change_order(df).orderBy("place").collect()] == [0, 3, 1, 2, 4, 5]
    assert [r.ord for r in changes.change_order(df.withColumn("parallel", F.lit(False))).orderBy("place").collect()] == [0, 1, 2, 3, 4, 5]


def test_deltas_balance(spark):
    events = spark.createDataFrame([("transfer", "a", "b", "x", 5), ("mint", None, "a", "x", 5), ("burn", "b", None, "x", 5), ("fee", "a", None, None, 9)], "kind string, source string, target string, asset string, amount long")
    assert deltas.summed(deltas.legs(events), keys=["holder", "asset"]).count() == 0
    state = spark.createDataFrame([("a", "x", 3, 10), ("b", "x", None, 1), ("c", "x", 4, None)], "holder string, asset string, pre long, post long")
    assert {r.holder: r.delta for r in deltas.state_deltas(state, keys=["holder", "asset"]).collect()} == {"a": 7, "b": 1, "c": -4}
    fixed = deltas.reconciled(deltas.state_deltas(state, keys=["holder", "asset"]), deltas.summed(deltas.legs(events), keys=["holder", "asset"]), keys=["holder", "asset"])
    assert {(r.holder, r.kind, r.amount) for r in fixed.collect()} == {("a", "mint", 7), ("b", "mint", 1), ("c", "burn", 4)}


def test_fee_classes(spark):
    df = spark.createDataFrame([(100, 3, False, 0), (100, 0, False, 0), (100, 1, True, 40)], "c long, o long, k boolean, r long")
    got = df.select(fees.fee_bucket(charged=C("c"), operations=C("o"), contract=C("k"), resource=C("r")).alias("f")).collect()
    assert [tuple(r.f) for r in got] == [("classic", 33), (None, None), ("inclusion", 60)]
    with pytest.raises(Exception, match="fee out of range"):
        spark.range(1).select(fees.fee_bucket(charged=F.lit(1), operations=F.lit(1), contract=F.lit(True), resource=F.lit(2))).collect()


@pytest.mark.parametrize(("pattern", "topics", "fits"), [(("a", "*"), ["a", "b"], True), (("a", "*"), ["a"], False), (("a", "**"), ["a"], True), (("a", "**"), ["a", "b", "c"], True), (("**",), [], True), (("*",), ["x"], True), (("a",), ["b"], False), (("a",), None, False)])
def test_topic_patterns(spark, pattern, topics, fits):
    df = spark.createDataFrame([(topics,)], "t array<string>")
    assert df.select(ev.fits_pattern(C("t"), pattern)).first()[0] is fits


def test_event_filters_check_their_form():
    for bad in [ev.EventFilter(topics=(("**", "a"),)), ev.EventFilter(topics=((),)), ev.EventFilter(topics=(("a",) * 5,)), ev.EventFilter(contracts=tuple(range(6)))]:
        with pytest.raises(ValueError, match="pattern|many"):
            bad.check()


def test_no_filters_fit_all_and_null_contracts_fit_no_list(spark):
    df = spark.createDataFrame([("contract", None, ["a"]), ("system", "c", ["a"])], "k string, c string, t array<string>")
    count = lambda fs: df.where(ev.fits(fs, kind=C("k"), contract=C("c"), topics=C("t"))).count()
    assert count([]) == 2 and count([ev.EventFilter(contracts=("c",))]) == 1 and count([ev.EventFilter(types=("system",)), ev.EventFilter(types=("contract",))]) == 2


def test_pages(spark):
    df = spark.range(10)
    assert [r.id for r in paging.page(df, key=C("id"), after=3, limit=2).collect()] == [4, 5]
    assert [r.id for r in paging.page(df, key=C("id"), after=3, limit=2, descending=True).collect()] == [2, 1]
    assert paging.slice_from(df, index="id", start=20, limit=0).count() == 0 and paging.slice_from(df, index="id", start=8, limit=5).count() == 2
    with pytest.raises(ValueError, match="limit"):
        paging.page(df, key=C("id"), limit=0)


def test_archives(spark):
    runs = archives.islands(spark.createDataFrame([(63,), (127,), (127,), (319,)], "c long"), value="c", step=64)
    assert sorted((r["first"], r["last"], r["n"]) for r in runs.collect()) == [(63, 127, 2), (319, 319, 1)]
    headers = spark.createDataFrame([(2, "b", "a"), (3, "c", "b"), (4, "d", "x"), (6, "f", "e")], "sequence long, hash string, prev_hash string")
    assert sorted((r.sequence, r.why) for r in archives.chain_breaks(headers).collect()) == [(4, "hash"), (6, "gap")]
    times = spark.createDataFrame([(100, 2), (105, 3), (110, 4)], "t long, v long")
    wanted = spark.createDataFrame([(103,), (0,), (105,), (999,)], "at long")
    got = {r.at: r.v for r in archives.as_of_forward(times, time="t", value="v", wanted=wanted, at="at").collect()}
    assert got == {103: 3, 0: 2, 105: 3, 999: 4}
    paths_ = spark.createDataFrame([("x/ledger/00/00/00/ledger-0000003f.xdr.gz",), ("x/other",)], "path string")
    assert [tuple(r) for r in lake.archive_files(paths_).collect()] == [("ledger", 63)]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(tuple(r) for r in tables.upserted(old, new, keys=["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.k for r in tables.without_range(old, column="k", start=1, end=2).collect()] == [2]
    good = spark.createDataFrame([(64,), (65,)], "s long")
    assert tables.packed_batches(good, sequence="s", per_file=64).first().sequences == [64, 65]
    with pytest.raises(Exception, match="contiguous"):
        tables.packed_batches(spark.createDataFrame([(64,), (66,)], "s long"), sequence="s", per_file=64).collect()


def test_access_logs(spark):
    lines = spark.createDataFrame([('a b c d e f g h i 200 "GET http://h/x HTTP/1.1"',), ('a b c d e f g h i 500 "GET http://h/y HTTP/1.1"',), ('a b c d e f g h i 200 "POST http://h/z HTTP/1.1"',)], "value string")
    assert [r.uri for r in lake.requests(lines).collect()] == ["http://h/x"]


def test_fee_movements_and_pools(spark):
    txs = spark.createDataFrame([(1, 23, 1, "a", 100, 30), (1, 23, 2, "b", 50, 0)], "ledger long, protocol int, tx_index long, tx_source string, fee_charged long, fee_refund long")
    moves = transfers.event_order(transfers.fee_movements(txs), order=["step"]).orderBy("place").collect()
    assert [(r.tx_index, r.step, r.amount) for r in moves] == [(1, "fee", 100), (2, "fee", 50), (1, "refund", -30)]
    ops = "ledger long, tx_index long, op_index long, tx_successful boolean, type string, op_source string, pool_id string, asset_a string, amount_a long, asset_b string, amount_b long"
    good = spark.createDataFrame([(1, 1, 1, True, "pool_withdraw", "a", "p", "x", 0, "y", 5)], ops)
    assert [(r.source, r.target, r.asset, r.amount) for r in transfers.pool_movements(good).collect()] == [("p", "a", "y", 5)]
    with pytest.raises(Exception, match="deposit of nothing"):
        transfers.pool_movements(spark.createDataFrame([(1, 1, 1, True, "pool_deposit", "a", "p", "x", 0, "y", 5)], ops)).collect()


def test_nested_ledgers_come_apart(spark):
    asked = [("h2", "acc2", [(None, 5)]), ("h1", "acc1", [("other", 1), (None, 2)])]
    done = [("h1", "success", [("state", "k", 1), ("updated", "k", 2), ("created", "n", 3)], [(1, "x"), (None, "y")]), ("h2", "failed", [], [])]
    ledger = "sequence long, protocol int, envelopes array<struct<hash:string,source:string,operations:array<struct<source:string,amount:long>>>>, processing array<struct<hash:string,result_code:string,changes:array<struct<type:string,key:string,entry:long>>,events:array<struct<op_index:int,body:string>>>>"
    batch = spark.createDataFrame([(64, 127, [(65, 23, asked, done)])], f"start long, end long, ledgers array<struct<{ledger.replace(' long', ':long').replace(' int', ':int').replace(' array', ':array').replace(', protocol', ',protocol').replace(', envelopes', ',envelopes').replace(', processing', ',processing')}>>")
    txs = flatten.transactions(flatten.ledgers(batch))
    ops = flatten.operations(txs).orderBy("position").collect()
    assert [(r.tx_index, r.op_index, r.op_source, r.tx_successful) for r in ops] == [(1, 1, "other", True), (1, 2, "acc1", True), (2, 1, "acc2", False)]
    assert [tuple(r) for r in flatten.changes(txs).orderBy("ord").collect()] == [(65, 1, 0, "updated", "k", 1, 2), (65, 1, 1, "created", "n", None, 3)]
    assert [r.body for r in flatten.events(txs).orderBy("cursor").collect()] == ["y", "x"]
    with pytest.raises(Exception, match="outside its batch"):
        flatten.ledgers(batch.withColumn("start", F.lit(66).cast("long"))).collect()
    lost = flatten.ledgers(batch).withColumn("envelopes", F.slice("envelopes", 1, 1))
    with pytest.raises(Exception, match="no envelope"):
        flatten.transactions(lost).collect()


def test_transaction_fields(spark):
    one = spark.range(1)
    memo = flatten.memo_text(F.lit("id"), F.lit(None), F.lit(7), F.lit(None))
    assert one.select(memo, flatten.bounds_text(F.lit(5), F.lit(0)), flatten.bounds_text(F.lit(5), F.lit(9)), flatten.close_ms(F.lit(2), F.lit(None).cast("long"))).first()[:] == ("7", "[5,)", "[5,9)", 2000)
    fee = flatten.fee_charged(F.lit(100), F.lit(30), contract=F.lit(True), fee_bump=F.lit(True), protocol=F.lit(20))
    assert one.select(fee, flatten.inclusion_fee(F.lit(100), F.lit(0), F.lit(2), contract=F.lit(False), fee_bump=F.lit(True))).first()[:] == (70, 33)
    atoms = spark.createDataFrame([([("a", 1), ("a", 2), ("b", 4), ("a", 8)],), ([],)], "atoms array<struct<asset_bought:string,amount_bought:long>>")
    assert [r[0] for r in atoms.select(flatten.receive_source_amount(F.lit(99).cast("long"), F.col("atoms"))).collect()] == [3, 99]
    who = spark.createDataFrame([([("k", 2)],)], "s array<struct<key:string,weight:int>>")
    assert who.select(flatten.signer_weights(F.col("s"), F.lit("me"), F.lit(1))).first()[0] == {"k": 2, "me": 1}


def test_checkpoint_log(spark):
    h = lambda c: c * 64
    states = spark.createDataFrame([(63, [(h("a"), h("b"), h("0"))]), (127, [(h("a"), h("c"), h("0"))])], "checkpoint long, levels array<struct<curr:string,snap:string,next:string>>")
    headers = spark.createDataFrame([(s, s * 5, 2) for s in range(1, 128)], "sequence long, close_time long, tx_count long")
    got = [tuple(r) for r in archives.checkpoint_log(states, headers).orderBy("checkpoint").collect()]
    assert got == [(63, 315, 126, None, "#"), (127, 635, 128, "_#", "#")]


def test_pool_changes(spark):
    kind = "struct<asset_a:string,reserve_a:long,asset_b:string,reserve_b:long>"
    df = spark.createDataFrame([(1, "p", ("x", 10, "y", 5), ("x", 4, "y", 9)), (2, "q", None, ("x", 7, "y", 1))], f"op long, pool_id string, pre {kind}, post {kind}")
    assert sorted(tuple(r) for r in deltas.pool_changes(df, keys=["op"]).collect()) == [(1, "p", "x", 6), (1, "p", "y", 4), (2, "q", "x", 7), (2, "q", "y", 1)]


@pytest.mark.parametrize("bad", [{"after": "c", "first": 1}, {"first": 5, "last": 4}, {"limit": 0}, {"limit": 101}, {"first": None}, {"filters": [ev.EventFilter()] * 6}])
def test_requests_are_checked(bad):
    good = {"filters": [], "limit": 10, "max_limit": 100, "first": 1}
    ev.check_request(**good)
    with pytest.raises(ValueError, match="range|limit|first|filters"):
        ev.check_request(**(good | bad))
