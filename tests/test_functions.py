from fractions import Fraction
from math import ceil, floor, gcd

import pytest
from hypothesis import given, settings, strategies as st
from plain_address import decode_one, encode_one
from pyspark.sql import functions as F

from tallyloom.functions import address, assets, ids, money, timing

C = F.col


def test_positions_go_there_and_back(spark):
    df = spark.createDataFrame([(0, 1, 1), (7, (1 << 20) - 1, 4095), ((1 << 31) - 1, 0, 0)], "l long, t long, o long")
    p = df.select("l", "t", "o", ids.position(C("l"), C("t"), C("o")).alias("p"))
    for r in p.select("l", "t", "o", ids.ledger_of(C("p")), ids.tx_of(C("p")), ids.op_of(C("p"))).collect():
        assert tuple(r[:3]) == tuple(r[3:])
    assert p.orderBy("l").select(ids.next_op(C("p"))).collect()[1][0] == 8 << 32


def test_positions_out_of_range_fail(spark):
    with pytest.raises(Exception, match="position out of range"):
        spark.range(1).select(ids.position(F.lit(1), F.lit(1 << 20), F.lit(0))).collect()


def test_object_keys_and_their_ranges(spark):
    df = spark.createDataFrame([(0,), (63,), (64,), (4294967295,)], "s long")
    keys = df.select("s", ids.object_key(C("s"), per_file=1, files_per_partition=64).alias("one"), ids.object_key(C("s"), per_file=64, files_per_partition=1).alias("many"))
    rows = keys.select("s", "one", "many", *[c.alias(n) for n, c in zip("abcd", [*ids.key_range(C("one")), *ids.key_range(C("many"))], strict=True)]).collect()
    assert rows[0].one == "FFFFFFFF--0-63/FFFFFFFF--0.xdr.zst"
    for r in rows:
        assert (r.a, r.b) == (r.s, r.s) and r.c <= r.s <= r.d


def test_checkpoints(spark):
    df = spark.createDataFrame([(0,), (62,), (63,), (64,), (127,), (4294967295,)], "s long")
    rows = df.select("s", ids.next_checkpoint(C("s")), ids.previous_checkpoint(C("s")), ids.is_checkpoint(C("s"))).collect()
    assert [tuple(r) for r in rows] == [(0, 63, 63, False), (62, 63, 63, False), (63, 63, 63, True), (64, 127, 63, False), (127, 127, 127, True), (4294967295, 4294967295, 4294967295, True)]


BIG = 9223372036854775807
CASES = [(0, 1, 1), (7, 3, 2), (BIG, 1, 1), (BIG, 2147483647, 2147483647), (BIG // 3, 3, 1), (1, 1, 3), (999999999999, 7, 13), (BIG, 1, 2147483647)]


def test_fractions_are_exact(spark):
    df = spark.createDataFrame(CASES, "x long, n long, d long")
    for r in df.select("x", "n", "d", money.mul_floor(C("x"), C("n"), C("d")), money.mul_ceil(C("x"), C("n"), C("d"))).collect():
        exact = Fraction(r.x * r.n, r.d)
        assert (r[3], r[4]) == (floor(exact), ceil(exact))


@pytest.mark.parametrize("case", [(BIG, 3, 1), (-1, 1, 1), (1, 1, 0)])
def test_fractions_out_of_range_fail(spark, case):
    df = spark.createDataFrame([case], "x long, n long, d long")
    with pytest.raises(Exception, match="64 bits|negative"):
        df.select(money.mul_floor(C("x"), C("n"), C("d"))).collect()


def test_buying_units(spark):
    for amount, needed, n, d in [(100, 1000, 3, 7), (100, 5, 3, 7), (100, 50, 7, 3)]:
        df = spark.createDataFrame([(amount, needed, n, d)], "a long, w long, n long, d long")
        bought, sold = df.select(*money.buying_units(C("a"), C("w"), C("n"), C("d"))).first()
        bound = amount if n > d else ceil(Fraction(floor(Fraction(amount * n, d)) * d, n))
        assert bought == min(bound, needed) and sold == ceil(Fraction(bought * n, d))


def test_gcd_and_prices(spark):
    df = spark.createDataFrame([(12, 18), (7, 1), (BIG, 1), (832040, 514229)], "a long, b long")
    assert [r[0] for r in df.select(money.gcd(C("a"), C("b"))).collect()] == [gcd(12, 18), 1, 1, gcd(832040, 514229)]
    assert spark.range(1).select(money.price_text(F.lit(1), F.lit(3)), money.price_text(F.lit(2), F.lit(3))).first()[:] == ("0.3333333", "0.6666667")


def test_amounts(spark):
    df = spark.createDataFrame([("1.5",), ("0.0000001",), ("-3",), ("1.12345678",), ("922337203685.4775807",), ("922337203685.4775808",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(money.parse_amount(C("t"))).collect()] == [15000000, 1, -30000000, None, BIG, None, None, None]
    assert spark.range(1).select(money.amount_text(F.lit(BIG)), money.long_amount_text(F.lit("-5")), money.long_amount_text(F.lit("123456789012345678901234567890"))).first()[:] == ("922337203685.4775807", "-0.0000005", "12345678901234567890123.4567890")


def test_pools(spark):
    for x, y, r, fee in [(1000, 1000, 10, 30), (10**12, 5 * 10**11, 12345, 0), (10, 10, 1, 30)]:
        df = spark.createDataFrame([(x, y, r, fee)], "x long, y long, r long, f long")
        paid, taken = df.select(money.pool_payout(C("x"), C("y"), C("r"), C("f")), money.pool_expectation(C("x"), C("y"), C("r"), C("f"))).first()
        keep = 10_000 - fee
        want = floor(Fraction(keep * y * r, 10_000 * x + keep * r))
        assert paid == (want if want > 0 else None)
        assert taken == (ceil(Fraction(x * r * 10_000, (y - r) * keep)) if r < y else None)
    assert spark.range(1).select(money.pool_payout(F.lit(-1), F.lit(1), F.lit(1), F.lit(0))).first()[0] is None


def test_addresses(spark):
    key = bytes(range(32))
    df = spark.createDataFrame([(bytearray(key),), (None,)], "k binary").select("k", address.encoder("account")(C("k")).alias("a"))
    rows = df.select("k", "a", address.decoder("account")(C("a")), address.decoder("contract")(C("a"))).collect()
    assert rows[0].a.startswith("G") and len(rows[0].a) == 56 and bytes(rows[0][2]) == key and rows[0][3] is None
    assert rows[1].a is None and rows[1][2] is None


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(sorted(address.VERSIONS)), st.binary(min_size=0, max_size=70), st.integers(0, 120), st.sampled_from("A7BZ1a?=")), min_size=20, max_size=20))
def test_addresses_like_the_standard_library(spark, cases):
    """Any key of any kind, there and back, and with a character changed."""
    rows = []
    for kind, key, place, char in cases:
        text = encode_one(address.VERSIONS[kind], key)
        at = place % len(text)
        rows.append((kind, bytearray(key), text, text[:at] + char + text[at + 1 :]))
    df = spark.createDataFrame([*rows, ("account", None, None, ""), ("account", bytearray(b"x"), "A", "AAAAAAAA")], "kind string, key binary, text string, other string")
    made = F.coalesce(*[F.when(C("kind") == k, address.encode(k, C("key"))) for k in address.VERSIONS])
    for r in df.select("kind", "key", "text", "other", made.alias("made"), address.decode(C("text")).alias("back"), address.decode(C("other")).alias("told")).collect():
        if r.key is None:
            assert r.made is None and r.back.key is None
        elif r.text != "A":
            assert r.made == r.text and bytes(r.back.key) == bytes(r.key) and r.back.kind == r.kind
        want = decode_one(r.other)
        assert (r.told.key is not None and (r.told.version, bytes(r.told.key)) or None) == want


def test_signed_payloads(spark):
    key = bytes(range(32))
    sizes = [0, 1, 3, 4, 63, 64, 65]
    df = spark.createDataFrame([(bytearray(key), bytearray(b"\xff" * n)) for n in sizes] + [(bytearray(b"short"), bytearray(b"x")), (None, bytearray(b"x"))], "k binary, p binary")
    rows = df.select("p", address.signed_payload(C("k"), C("p")).alias("a")).select("p", "a", address.signed_payload_parts(C("a")).alias("b")).collect()
    for n, r in zip(sizes, rows, strict=False):
        want = encode_one(address.VERSIONS["signed_payload"], key + n.to_bytes(4, "big") + b"\xff" * n + b"\0" * (-n % 4)) if 1 <= n <= 64 else None
        assert r.a == want and (want is None or (bytes(r.b.key), bytes(r.b.payload)) == (key, b"\xff" * n))
    assert rows[-1].a is None and rows[-2].a is None
    bad = encode_one(address.VERSIONS["signed_payload"], key + (1).to_bytes(4, "big") + b"ab\0\0")  # not filled with zeros
    assert tuple(spark.range(1).select(address.signed_payload_parts(F.lit(bad))).first()[0]) == (None, None)


def test_assets(spark):
    got = spark.range(1).select(assets.parse_list(F.lit("native, USD:x,bad,:y"))).first()[0]
    assert [(r.code, r.issuer) for r in got] == [("native", None), ("USD", "x"), (None, None), (None, None)]
    assert spark.range(1).select(assets.address_parts(F.lit("a*b.c")), assets.address_parts(F.lit("a*b*c"))).first()[:] == (("a", "b.c"), (None, None))


def test_time_buckets(spark):
    df = spark.createDataFrame([(0,), (59_999,), (60_000,), (-1,)], "ms long")
    assert [r[:] for r in df.select(timing.round_down(C("ms"), 60_000), timing.round_up(C("ms"), 60_000)).collect()] == [(0, 0), (0, 60_000), (60_000, 60_000), (-60_000, 0)]


def test_prices_from_text(spark):
    df = spark.createDataFrame([("0.5",), ("3.1415926",), ("1000000000.5",), ("0.0000000003",), ("4294967296",), ("x",), ("-1",), (None,)], "t string")
    got = [tuple(r[0]) for r in df.select(money.parse_price(C("t"))).collect()]
    assert got[0] == (1, 2) and got[1] == (15707963, 5000000) and got[4:] == [(None, None)] * 4
    for (n, d), t in zip(got[2:4], ("1000000000.5", "0.0000000003"), strict=True):
        assert n is None or abs(Fraction(n, d) - Fraction(t)) <= Fraction(t)


def test_muxed_addresses(spark):
    key = bytes(range(32))
    text = encode_one(address.VERSIONS["muxed"], key + (2**63 + 5).to_bytes(8, "big"))
    df = spark.createDataFrame([(text,), ("M",), (None,)], "a string")
    rows = df.select(address.kind_of(C("a")), address.muxed_parts(C("a"))).collect()
    assert rows[0][0] == "muxed" and rows[0][1].account == encode_one(address.VERSIONS["account"], key) and int(rows[0][1].id) == 2**63 + 5
    assert rows[1][1].account is None and rows[2][1].account is None


def test_path_prefixes(spark):
    assert spark.range(1).select(ids.path_prefixes(F.lit(63).cast("long"), F.lit(300).cast("long"))).first()[0] == ["00/00/00", "00/00/01"]
