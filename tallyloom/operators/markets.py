"""Candles of trades, order books and statistics of assets."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions.money import floor_div, gcd, price_order
from tallyloom.functions.staged import staged
from tallyloom.functions.timing import round_down
from tallyloom.sinks.scratch import written

#: Lengths of a candle in milliseconds that are offered. Fixed values.
RESOLUTIONS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "1h": 3_600_000, "1d": 86_400_000, "1w": 604_800_000}


def candles(trades: DataFrame, *, keys: list[str], ms: Column, base: str, counter: str, order: list[str], resolution: int, offset: int = 0, rationals: bool = False) -> DataFrame:
    """Trades by ``keys`` and time bucket: count, volumes, average, and first, last, greatest and least price.

    A price is counter by base, in whole 10**-7 parts, rounded down; of equal times ``order`` decides which trade is
    first. The average is of volumes. With ``rationals`` the four prices also come as exact fractions ``high_r`` (n, d)
    and so on, reduced. Amounts are 64-bit numbers; sums and what follows from them have 38 digits. Everything is an
    aggregate with a map-side combine, over longs: volumes are summed as halves of 32 bits, and only prices of amounts that
    need it take 38 digits.
    """
    c = F.col
    ten, wide = F.lit(10_000_000).cast("decimal(8,0)"), lambda x: x.cast("decimal(19,0)")
    rows = trades.where(c(base) > 0).select(*keys, round_down(ms, resolution, offset).alias("timestamp"), c(base).cast("long").alias("__b"), c(counter).cast("long").alias("__c"), F.struct(ms.alias("ms"), *order).alias("__o"))
    most, div = ((1 << 63) - 1) // 10_000_000, lambda a, b: F.call_function("div", a, b)
    whole_part, rest = div(c("__c"), c("__b")), c("__c") % c("__b")
    split, parts = (c("__c") >= 0) & (rest <= most), div(rest * 10_000_000, c("__b"))  # then 63 bits hold what follows the whole part
    small = split & (whole_part < most)  # then they hold the price; others take 38 digits
    short = F.when(small, whole_part * 10_000_000 + parts)
    long_ = F.when(~small, F.when(split, (wide(whole_part) * ten + parts.cast("decimal(8,0)")).cast("decimal(38,0)")).otherwise(floor_div((wide(c("__c")) * ten).cast("decimal(38,0)"), wide(c("__b")))))
    rows = staged(rows, {"__p": short, "__w": long_})
    price = lambda p, w: F.coalesce(p.cast("decimal(38,0)"), w)
    four = [F.max("__p").alias("__hp"), F.max("__w").alias("__hw"), F.min("__p").alias("__lp"), F.min("__w").alias("__lw"), *[f(n, "__o").alias(f"__{side}{n[2:]}") for side, f in (("open", F.min_by), ("close", F.max_by)) for n in ("__p", "__w")]]
    if rationals:
        rows = staged(rows, {"__k": price_order(c("__c"), c("__b"))}).withColumn("__r", F.struct(c("__c").alias("n"), c("__b").alias("d")))
        four += [F.max_by("__r", "__k").alias("high_r"), F.min_by("__r", "__k").alias("low_r"), F.min_by("__r", "__o").alias("open_r"), F.max_by("__r", "__o").alias("close_r")]
    halves = [f(n).alias(f"__{k}{n}") for n in ("__b", "__c") for k, f in (("hi", lambda n: F.sum(F.shiftright(n, 32))), ("lo", lambda n: F.sum(F.col(n).bitwiseAND(F.lit((1 << 32) - 1)))))]
    whole = lambda n: (c(f"__hi{n}").cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + c(f"__lo{n}").cast("decimal(19,0)")).cast("decimal(29,0)")
    out = rows.groupBy(*keys, "timestamp").agg(F.count("*").alias("trade_count"), *halves, *four)
    made = {"high": F.greatest(c("__hp").cast("decimal(38,0)"), c("__hw")), "low": F.least(c("__lp").cast("decimal(38,0)"), c("__lw")), "open": price(c("__openp"), c("__openw")), "close": price(c("__closep"), c("__closew"))}
    out = out.select(*keys, "timestamp", "trade_count", whole("__b").alias("base_volume"), whole("__c").alias("counter_volume"), *[v.alias(k) for k, v in made.items()], *(["high_r", "low_r", "open_r", "close_r"] if rationals else []))
    out = out.withColumn("average", floor_div((c("counter_volume") * ten).cast("decimal(38,0)"), c("base_volume")))
    for name in ("high_r", "low_r", "open_r", "close_r") if rationals else ():
        shared = gcd(F.col(f"{name}.n"), F.col(f"{name}.d"))
        out = out.withColumn(name, F.transform(F.array(F.struct(F.col(f"{name}.n").alias("n"), F.col(f"{name}.d").alias("d"), shared.alias("g"))), lambda x: F.struct(_whole(x["n"], x["g"]).alias("n"), _whole(x["d"], x["g"]).alias("d")))[0])
    return out


def _whole(a: Column, b: Column) -> Column:
    """a / b of longs where b divides a."""
    return F.call_function("div", a, b)


def order_book(offers: DataFrame, *, side: str, n: str, d: str, amount: str, keys: list[str] | None = None, depth: int = 20) -> DataFrame:
    """Amounts by price level, the best ``depth`` levels of each side: asks from the least price, bids from the greatest.

    A level is a price as written: 1/2 and 2/4 are two levels, one after the other. Prices are compared as decimals, which
    is exact for numerators and denominators of 31 bits, as prices have. ``offers`` are read twice: first for a bound that at
    least ``depth`` levels of a side reach, then for the levels up to it, so that only about as many are gathered and sorted.
    """
    keys = keys or []
    price = F.col(n).cast("decimal(19,0)") / F.col(d).cast("decimal(19,0)")
    best = F.when(F.col(side) == "ask", price).otherwise(-price)
    # Prices are dealt to buckets by hash. The bests of ``depth`` buckets are as many levels, so none beyond the last of them is among the first.
    groups = [*keys, side]
    bests = offers.groupBy(*groups, F.pmod(F.xxhash64(n, d), F.lit(4 * depth)).alias("__bucket")).agg(F.min(best).alias("__bound"))
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("__bound").asc_nulls_last()))
    bounds = bests.withColumn("__place", place).where(F.col("__place") == depth).select(*[F.col(g).alias(f"__of_{i}") for i, g in enumerate(groups)], "__bound")
    bounds = written(bounds, "bounds")  # so its size is known, and few bounds go to the offers
    same = functools.reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"__of_{i}")) for i, g in enumerate(groups)])
    near = offers.join(bounds, same, "left").where(F.coalesce(best <= F.col("__bound"), F.lit(True))).select(*offers.columns)
    levels = near.groupBy(*groups, n, d).agg(F.sum(amount).alias("amount"))
    w = Window.partitionBy(*groups).orderBy(best, F.col(n), F.col(d))
    return levels.withColumn("level", F.row_number().over(w).cast("long")).where(F.col("level") <= depth)


def asset_stats(holdings: DataFrame, *, keys: list[str], balance: str, status: str, statuses: list[str]) -> DataFrame:
    """Holders and balances of an asset by class of authorisation, a column pair each."""
    cols = []
    for s in statuses:
        cols += [F.count_if(F.col(status) == s).alias(f"holders_{s}"), F.coalesce(F.sum(F.when(F.col(status) == s, F.col(balance))), F.lit(0)).cast("long").alias(f"balance_{s}")]
    return holdings.groupBy(*keys).agg(*cols, F.count("*").alias("holders"))


def ledger_counts(txs: DataFrame, *, keys: list[str], success: Column, operations: Column) -> DataFrame:
    """Transactions and operations, all and successful."""
    return txs.groupBy(*keys).agg(F.count_if(success).alias("good_txs"), F.count("*").alias("all_txs"), F.coalesce(F.sum(F.when(success, operations)), F.lit(0)).cast("long").alias("good_ops"), F.sum(operations).cast("long").alias("all_ops"))


def book_faults(offers: DataFrame, *, offer: str = "offer_id", selling: str = "selling", buying: str = "buying", amount: str = "amount", n: str = "n", d: str = "d") -> DataFrame:
    """What no order book may hold, one row a fault (offer, fault): an id that stands for several offers, an amount or a price that is not above 0 or missing, and an asset offered for itself. A sound book gives no rows."""
    above = lambda x: F.coalesce(F.col(x) > 0, F.lit(False))
    checks = {"amount": ~above(amount), "price": ~(above(n) & above(d)), "same asset": F.col(selling).eqNullSafe(F.col(buying))}
    faults = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())
    single = offers.select(F.col(offer).alias("offer_id"), F.explode(faults).alias("fault")).distinct()
    twice = offers.groupBy(F.col(offer).alias("offer_id")).agg(F.count("*").alias("k")).where("k > 1").select("offer_id", F.lit("several offers").alias("fault"))
    return single.unionByName(twice)


def asset_report(lines: DataFrame, claimables: DataFrame, pools: DataFrame, contracts: DataFrame, *, statuses: tuple[str, ...] = ("authorized", "maintain", "unauthorized")) -> DataFrame:
    """Who holds an asset, and how much: trust lines by authorisation, claimable balances, pools and contracts, a column pair each.

    ``lines``: (asset, status, balance). ``claimables`` and ``contracts``: (asset, amount). ``pools``: (asset_a, asset_b, reserve_a, reserve_b); a
    pool holds both of its assets. The native asset and rows without an asset are left out; a trust line of another status
    counts in none of the pairs. Amounts are added with 38 digits. An asset has a row if anything holds it. All four are one
    bag of (asset, class, amount), so there is one aggregate with a map-side combine and no join.
    """
    c = F.col
    wide = lambda x: c(x).cast("decimal(38,0)").alias("amount")
    sides = F.array(*[F.struct(c(f"asset_{s}").alias("asset"), c(f"reserve_{s}").alias("amount")) for s in "ab"])
    parts = [
        lines.select("asset", c("status").alias("class"), wide("balance")),
        claimables.select("asset", F.lit("claimable").alias("class"), wide("amount")),
        pools.select(F.explode(sides).alias("s")).select("s.asset", F.lit("pool").alias("class"), wide("s.amount")),
        contracts.select("asset", F.lit("contract").alias("class"), wide("amount")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    classes = [*statuses, "claimable", "pool", "contract"]
    pairs = [x for k in classes for x in (F.count_if(c("class") == k).alias(f"n_{k}"), F.coalesce(F.sum(F.when(c("class") == k, c("amount"))), F.lit(0)).cast("decimal(38,0)").alias(f"amount_{k}"))]
    return rows.where((c("asset") != "native") & c("class").isin(*classes)).groupBy("asset").agg(*pairs)


def counter_faults(stated: DataFrame, counted: DataFrame, *, keys: list[str], counters: list[str]) -> DataFrame:
    """Keys whose stated counters are not the counted ones, one row a counter: (…, counter, stated, counted).

    A key that was not counted has counted 0; a key that nobody states has a null ``stated``. One full join by key.
    """
    c = F.col
    rows = stated.select(*keys, F.struct(*counters).alias("__s")).join(counted.select(*keys, F.struct(*counters).alias("__c")), keys, "full")
    each = F.array(*[F.struct(F.lit(n).alias("counter"), c("__s")[n].cast("long").alias("stated"), F.coalesce(c("__c")[n].cast("long"), F.lit(0)).alias("counted")) for n in counters])
    return rows.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*").where(~c("stated").eqNullSafe(c("counted")))


def pool_faults(pools: DataFrame, *, fee: int = 30) -> DataFrame:
    """What no set of pools may hold, one row a fault (pool_id, fault).

    ``pools``: (pool_id, asset_a, asset_b, reserve_a, reserve_b, fee_bps). Assets must differ and stand in order, reserves be there and
    not negative, the fee be ``fee``; an id stands for one pool and a pair has one pool. A sound set gives no rows.
    """
    c = F.col
    there = lambda x: F.coalesce(c(x) >= 0, F.lit(False))
    checks = {"order of assets": ~F.coalesce(c("asset_a") < c("asset_b"), F.lit(False)), "reserve": ~(there("reserve_a") & there("reserve_b")), "fee": ~c("fee_bps").eqNullSafe(F.lit(fee))}
    single = pools.select("pool_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))).alias("fault")).distinct()
    twice = pools.groupBy("pool_id").agg(F.count("*").alias("n")).where("n > 1").select("pool_id", F.lit("several pools").alias("fault"))
    pair = pools.groupBy(F.least("asset_a", "asset_b").alias("__a"), F.greatest("asset_a", "asset_b").alias("__b")).agg(F.count_distinct("pool_id").alias("n"), F.min("pool_id").alias("pool_id")).where("n > 1")
    return single.unionByName(twice).unionByName(pair.select("pool_id", F.lit("several pools of a pair").alias("fault")))


def level_faults(offers: DataFrame, levels: DataFrame) -> DataFrame:
    """Price levels that are not what their offers make, as (selling, buying, n, d, made_offers, made_amount, held_offers, held_amount).

    ``offers``: (selling, buying, amount, n, d); ``levels``: (selling, buying, n, d, offers, amount), prices in lowest terms. Sides that lack a
    level are null. A sound index gives no rows.
    """
    c = F.col
    shared = gcd(c("n").cast("long"), c("d").cast("long"))
    lowest = offers.select("selling", "buying", "amount", c("n").cast("long").alias("n"), c("d").cast("long").alias("d"), shared.alias("g"))
    lowest = lowest.select("selling", "buying", "amount", _whole(c("n"), c("g")).alias("n"), _whole(c("d"), c("g")).alias("d"))
    keys = ["selling", "buying", "n", "d"]
    made = lowest.groupBy(*keys).agg(F.count("*").alias("made_offers"), F.sum(c("amount").cast("decimal(38,0)")).cast("decimal(38,0)").alias("made_amount"))
    held = levels.select(*keys, c("offers").alias("held_offers"), c("amount").cast("decimal(38,0)").alias("held_amount"))
    rows = made.join(held, keys, "full")
    return rows.where(~(c("made_offers").eqNullSafe(c("held_offers")) & c("made_amount").eqNullSafe(c("held_amount"))))
