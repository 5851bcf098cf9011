"""What queries move, hold and compute as tables grow, by their plans and on odd tables."""

import re

from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_revocations_move_their_inputs_once(spark):
    from tallyloom.operators.revocations import revocation_movements

    pools = spark.range(0).selectExpr("id as ledger", "1 as tx_index", "1 as op_index", "cast('p' as binary) as pool", "cast('a' as binary) as asset_a", "cast('b' as binary) as asset_b", "id as amount_a", "id as amount_b")
    created = spark.range(0).selectExpr("id as ledger", "1 as tx_index", "1 as op_index", "cast('p' as binary) as balance_id", "cast('a' as binary) as asset", "id as amount")
    txs = spark.range(0).selectExpr("id as ledger", "1 as tx_index", "cast('p' as binary) as account", "id as sequence")
    assert plan_of(revocation_movements(pools, created, txs)).count("Exchange ") <= 1


def test_revocations_leave_inputs_where_they_are_dealt_alike(spark):
    from tallyloom.operators.revocations import revocation_movements

    ledgers = lambda n: spark.range(0).withColumnRenamed("id", "ledger").repartition(n, "ledger")
    pools = ledgers(4).selectExpr("ledger", "1 as tx_index", "1 as op_index", "cast('p' as binary) as pool", "cast('a' as binary) as asset_a", "cast('b' as binary) as asset_b", "2L as amount_a", "3L as amount_b")
    created = ledgers(4).selectExpr("ledger", "1 as tx_index", "1 as op_index", "cast('p' as binary) as balance_id", "cast('a' as binary) as asset", "2L as amount")
    txs = lambda n: ledgers(n).selectExpr("ledger", "1 as tx_index", "cast('p' as binary) as account", "ledger as sequence")
    assert "ENSURE_REQUIREMENTS" not in (alike := plan_of(revocation_movements(pools, created, txs(4)))) and "REPARTITION_BY_COL" not in alike
    assert plan_of(revocation_movements(pools, created, txs(3))).count("ENSURE_REQUIREMENTS") == 1


def test_revoked_lines_are_dealt_before_their_digests_are_made(spark):
    from tallyloom.plans import contract_queries, registry  # noqa: F401  the import registers the queries

    plan = plan_of(registry.QUERIES["q94_revoked_trust_lines"](spark, "/root/testdata/sf0.001"))
    moved = re.findall(r"Exchange hashpartitioning\((\w+)#\w+, \d+\), (\w+)", plan)
    assert len(moved) == plan.count("Exchange ") and set(moved) == {(key, "REPARTITION_BY_NUM") for key in ("o_orderkey", "l_orderkey")}


def test_long_ranges_of_folders_are_whole_texts(spark):
    from tallyloom.functions import ids

    ranges = [(1, 1), (1, 63), (1, 64), (255, 256), (0, 65535), (16000, 70000), (65000, 200000), (4294960000, 4294967295)]
    rows = spark.createDataFrame(ranges, "a long, b long")
    for every in (64, 8, 256):
        got = rows.select(ids.path_prefix_text(F.col("a"), F.col("b"), every).alias("t"), F.array_join(F.array_sort(ids.path_prefixes(F.col("a"), F.col("b"), every)), ",").alias("u")).collect()
        assert [r.t for r in got] == [r.u for r in got] and all(r.t for r in got)
    assert rows.select(ids.path_prefix_text(F.col("b"), F.col("a") - 70000)).first()[0] is None


def test_numbers_beyond_128_bits_are_exact(spark):
    from tallyloom.functions import money
    from tallyloom.plans import projection_queries

    pairs = [(h, w) for h in (0, 1, -1, 200_001 * 46116860184273, -7_200_000 * 46116860184273, 10**19, -(10**37) + 1, 2**63, -(2**63)) for w in (0, 1, 10**19, 2**64 - 1)]
    rows = spark.createDataFrame([(str(h), str(w)) for h, w in pairs], "h string, w string")
    got = rows.select(money.wide_text_from_halves(F.col("h").cast("decimal(38,0)"), F.col("w").cast("decimal(20,0)"))).collect()
    assert [r[0] for r in got] == [str(h * 2**64 + w) for h, w in pairs]

    class One:
        lineitem = spark.sql("select 1L as l_orderkey, 1 as l_linenumber, 1200000L as l_partkey, 3L as l_suppkey, 12.34D as l_extendedprice")

    assert projection_queries.q87(One).first().raw == str(-1_200_000 * 46116860184273 * 2**64 + 1234 * 1000000007000)


def test_offers_that_share_an_id_are_in_order_of_their_amount(spark):
    from tallyloom.operators import paths

    offers = [("a", "b", n, 3, 2, 7) for n in (9, 1, 5, 3, 7)]
    for rows in (offers, offers[::-1]):
        frame = spark.createDataFrame(rows, "selling string, buying string, amount long, n long, d long, offer_id long").coalesce(1)
        got = {r.amount: int(r.amount_before) for r in paths.levels(frame).collect()}
        assert got == {1: 0, 3: 1, 5: 4, 7: 9, 9: 16}


def test_events_pass_python_twice_at_most(spark):
    from tallyloom.operators import contract_events as ce

    rows = spark.range(0).selectExpr("id as ledger", "1 as tx_index", "1 as op_index", "4 as meta_version", "'contract' as type", "cast('c' as binary) as contract", "0 as body_version", "array(parse_json('1')) as topics", "parse_json('1') as data")
    assert plan_of(ce.read_events(rows, network=F.lit(b"n"))).count("ArrowEvalPython") <= 2


def test_hashes_are_joined_as_bytes(spark):
    from tallyloom.plans import catalog

    class One:
        orders = spark.sql("select 1L as o_orderkey, 2000D as o_totalprice union all select 2L, 10D")
        lineitem = spark.sql("select 1L as l_orderkey, 4 as l_linenumber union all select 1L, 2 union all select 3L, 1")

    assert sorted(map(tuple, catalog.q30(One).collect())) == [(1, 2, True, 1), (1, 4, True, 2)]
    assert "unhex(sha2(" in catalog.q30(One)._jdf.queryExecution().analyzed().toString()


def test_envelopes_are_moved_as_bytes(spark):
    from tallyloom.operators import hash_trees as ht

    envelopes = spark.sql("select 1L as sequence, cast('a' as binary) as body")
    headers = spark.sql("select 1L as sequence, sha2('x', 256) as prev_hash")
    made = ht.set_hashes(envelopes, headers)
    assert "hex(body" not in made._jdf.queryExecution().analyzed().toString()
    assert made.first().hash == spark.sql("select sha2(concat(unhex(sha2('x', 256)), cast('a' as binary)), 256)").first()[0]


def test_fractions_sort_and_shorten_exactly(spark):
    import random
    from fractions import Fraction
    from math import gcd

    from tallyloom.functions import money

    rng = random.Random(5)
    top = 2**63 - 1
    pairs = [(top, top - 1), (top - 1, top - 2), (1, top), (1, top - 1), (0, 7), (0, top), (1, 2), (2, 4), (top, 1), (2**31, 2**31), (2**31 - 1, 2**31), (832040, 514229)]
    pairs += [(7540113804746346429, 4660046610375530309), (4660046610375530309, 7540113804746346429)]  # Fibonacci numbers take the most steps
    pairs += [(rng.randrange(1 << rng.randrange(1, 63)), 1 + rng.randrange(1 << rng.randrange(1, 63))) for _ in range(300)]
    pairs += [(n * 3 + 1, d * 3) for n, d in pairs if max(n, d) < top // 4]
    rows = spark.createDataFrame(pairs, "n long, d long")
    got = rows.select("n", "d", money.price_order(F.col("n"), F.col("d")).alias("k"), money.gcd(F.col("n"), F.col("d")).alias("g")).collect()
    assert all(r.g == gcd(r.n, r.d) for r in got)
    by_key, by_value = {}, {}
    for r in got:
        by_key.setdefault(tuple(r.k), set()).add(Fraction(r.n, r.d))
        by_value.setdefault(Fraction(r.n, r.d), set()).add(tuple(r.k))
    assert all(len(v) == 1 for v in (*by_key.values(), *by_value.values()))
    assert [next(iter(by_key[k])) for k in sorted(by_key)] == sorted(by_value)


def _largest_method(df):
    import re

    session = df.sparkSession
    mode = session._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    return max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode)))


def test_fractions_and_candles_compile_to_small_methods(spark):
    """The JVM interprets methods above 8,000 bytes of code, which took 62 microseconds a row."""
    from tallyloom.functions import money
    from tallyloom.operators import markets

    rows = spark.range(100).selectExpr("id as amount", "id + 5 as needed", "id + 1 as n", "id % 7 + 1 as d", "1 as part", "id as ms")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        taken = money.with_buying_units(rows)
        assert _largest_method(taken) < 8000
        bars = markets.candles(rows, keys=["part"], ms=F.col("ms"), base="d", counter="amount", order=["ms"], resolution=60_000, rationals=True)
        assert _largest_method(bars) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    c = F.col
    assert sorted(taken.select("n", "d", "bought", "sold").collect()) == sorted(rows.select("n", "d", *[x.alias(n) for x, n in zip(money.buying_units(c("amount"), c("needed"), c("n"), c("d")), ("bought", "sold"), strict=True)]).collect())


def test_sums_of_a_book_beyond_63_bits(spark):
    from tallyloom.operators import paths

    top = 2**63 - 1
    offers = spark.createDataFrame([(1, "a", "b", top, 1, 4), (2, "a", "b", top, 1, 2), (3, "a", "b", 5, 1, 1), (4, "c", "b", top, 2, 1), (5, "c", "b", 5, 3, 1), (6, "d", "b", top, 2**31 - 1, 1)], "offer_id long, selling string, buying string, amount long, n long, d long")
    rows = paths.levels(offers)
    assert {f.dataType.simpleString() for f in rows.schema.fields[2:]} == {"bigint"}
    quarter, half = -(-top // 4), -(-top // 2)
    got = {(r.selling, r.n, r.d): (r.amount_before, r.cost, r.cost_before) for r in rows.collect()}
    assert got == {("a", 1, 4): (0, quarter, 0), ("a", 1, 2): (top, half, quarter), ("a", 1, 1): (None, 5, quarter + half), ("c", 2, 1): (0, top, 0), ("d", 2**31 - 1, 1): (0, top, 0)}


def test_few_wanted_amounts_leave_the_book_where_it_is(spark):
    from tallyloom.operators import paths
    from tallyloom.sinks.scratch import written

    offers = spark.range(3000).selectExpr("id as offer_id", "concat('a', id % 3) as selling", "concat('a', (id + 1) % 3) as buying", "id % 50 + 1 as amount", "id % 7 + 1 as n", "id % 5 + 1 as d")
    level = written(paths.levels(offers), "levels")
    wants = spark.createDataFrame([("a0", 40)], "asset string, amount long")
    assert "Exchange hashpartitioning" not in plan_of(paths.bought(wants, level))


def test_order_books_keep_what_a_sort_of_all_levels_keeps(spark):
    from tallyloom.operators.markets import order_book

    rows = spark.range(4000).selectExpr("if(id % 5 = 0, null, id % 3) as market", "if(id % 2 = 0, 'ask', if(id % 7 = 0, null, 'bid')) as side", "id * 7919 % 401 as n", "id % 11 + 1 as d", "id as amount")
    rows = rows.unionByName(spark.createDataFrame([(9, "ask", None, 2, 5), (9, "ask", 3, 2, 5), (9, "ask", 6, 4, 5)], "market long, side string, n long, d long, amount long"))
    got = order_book(rows, keys=["market"], side="side", n="n", d="d", amount="amount", depth=4).collect()
    books = {}
    for r in rows.collect():
        book = books.setdefault((r.market, r.side), {})
        book[r.n, r.d] = book.get((r.n, r.d), 0) + r.amount
    want = set()
    for (market, side), book in books.items():
        order = sorted(book, key=lambda x: (x[0] is not None, 0 if x[0] is None else x[0] / x[1] if side == "ask" else -x[0] / x[1], x[0] or 0, x[1]))
        want |= {(market, side, n, d, book[n, d], i + 1) for i, (n, d) in enumerate(order[:4])}
    assert {(r.market, r.side, r.n, r.d, r.amount, r.level) for r in got} == want and len(got) == len(want)


def test_order_books_sort_few_levels(spark):
    from tallyloom.operators.markets import order_book

    rows = spark.range(50000).selectExpr("id % 2 as market", "'ask' as side", "id as n", "1 as d", "id as amount")
    book = order_book(rows, keys=["market"], side="side", n="n", d="d", amount="amount", depth=5)
    assert "__bound" in book._jdf.queryExecution().toString() and book.count() == 10


def test_digests_of_lists_are_made_by_many_tasks(spark):
    from tallyloom.plans import archive_queries

    class Few:
        customer = spark.range(0, 500, 1, 1).select(F.col("id").alias("c_custkey"))

    report = archive_queries.q95d(Few())
    assert "bucket_list_hash" in report._jdf.queryExecution().toString() and report.count() == sum(k % 13 == 0 or k % 17 == 0 for k in range(500))
    plan = plan_of(report)
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("REPARTITION_BY_NUM") == 2


def test_a_book_keeps_63_bits_and_nulls(spark, tmp_path):
    from tallyloom.streaming import book_stream

    top, schema = 2**63 - 1, "ledger long, place int, what string, removed boolean, selling string, buying string, id long, amount long, n long, d long, reserve_a long, reserve_b long"
    rows = [(1, 0, "offer", False, "x", "y", top, 5, 1, 2, None, None), (2, 0, "offer", False, "x", "y", top, top, 1, 3, None, None), (2, 1, "offer", False, "x", "y", top - 1, top - 2, 2, 6, None, None)]
    rows += [(3, 0, "offer", True, "x", "y", 7, None, None, None, None, None), (3, 1, "pool", False, "x", "y", None, None, None, None, top, None)]
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    changes = book_stream.book_changes(spark.readStream.schema(schema).parquet(folder), parts=1)
    assert "numbers#" in changes._jdf.queryExecution().logical().toString()
    book_stream.run_book(spark.readStream.schema(schema).parquet(folder), path=str(tmp_path / "out"), checkpoint=checkpoint, parts=1)
    assert [tuple(r)[2:] for r in book_stream.book_levels(spark, checkpoint).collect()] == [(1, 3, 2, 2 * top - 2)]
    assert [tuple(r)[2:] for r in book_stream.book_pools(spark, checkpoint).collect()] == [(top, None)]


def test_balances_read_few_addresses_once(spark):
    from tallyloom.functions import address, contract_values as cv
    from tallyloom.operators.contract_data import balance_rows

    rows = spark.range(1).select(F.lit(b"c" * 32).alias("contract"), F.lit("persistent").alias("durability"), *[cv.parsed(F.concat(F.lit(x), F.col("id").cast("string"))).alias(n) for n, x in (("key", "{}"), ("val", "{}"))])
    found = balance_rows(rows, network=F.lit(b"n" * 32)).select("contract", "holder", "holder_key", "amount")
    assert plan_of(found).count("ArrowEvalPython") == 1
    text = lambda n: "[" + ",".join(['{"symbol":"Balance"}', '{"address":"%s"}' % address.encode_all(16, [b"h" * 32])[0], "null"][:n]) + "]"
    entries = lambda n: "[" + ",".join('{"key":{"symbol":"%s"},"val":%s}' % x for x in [("amount", '{"i128":"5"}'), ("authorized", '{"bool":true}'), ("clawback", '{"bool":false}'), ("more", "null")][:n]) + "]"
    made = spark.createDataFrame([(k, v, '{"vec":%s}' % text(k), '{"map":%s}' % entries(v)) for k in (1, 2, 3) for v in (2, 3, 4)], "k int, v int, key string, val string")
    made = made.select("k", "v", F.lit(b"c" * 32).alias("contract"), F.lit("persistent").alias("durability"), cv.parsed(F.col("key")).alias("key"), cv.parsed(F.col("val")).alias("val"))
    assert [(r.k, r.v, r.amount, bytes(r.holder_key)) for r in balance_rows(made, network=F.lit(b"n" * 32)).collect()] == [(2, 3, "5", b"h" * 32)]


def test_texts_of_long_ranges_are_made_by_all_tasks(spark):
    from tallyloom.plans import projection_queries, registry  # noqa: F401  the import registers the queries

    rows = registry.QUERIES["q88e_prefixes_and_ranges"](spark, "/root/testdata/sf0.001")
    assert rows.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
