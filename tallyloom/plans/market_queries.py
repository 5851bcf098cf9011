"""Queries of candles, deltas, payment paths and token movements beyond those of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators import deltas, markets, paths, transfers
from tallyloom.plans import views
from tallyloom.plans.registry import Tables, query
from tallyloom.sinks import scratch
from tallyloom.plans.views import LEVELS, TRADES

WEEK = markets.RESOLUTIONS["1w"]
BIG = 500_000_000_000


@query("q01b_candles_of_large_amounts", f"""with {TRADES}, p as (select part, ms, ledger, line, base, counter::hugeint * {BIG} as counter, (counter::hugeint * {BIG} * 10000000) // base as price, ms // {WEEK} * {WEEK} as "timestamp" from tr where base > 0),
c as (select part, "timestamp", count(*) as trade_count, sum(base)::hugeint as base_volume, sum(counter)::hugeint as counter_volume, max(price) as high, min(price) as low,
 arg_max({{'n': counter, 'd': base}}, counter::decimal(38, 0) / base) as h, arg_min({{'n': counter, 'd': base}}, counter::decimal(38, 0) / base) as l from p group by 1, 2)
select part, "timestamp", trade_count, base_volume::decimal(38, 0) as base_volume, counter_volume::decimal(38, 0) as counter_volume, high::decimal(38, 0) as high, low::decimal(38, 0) as low,
 ((counter_volume * 10000000) // base_volume)::decimal(38, 0) as average, (h.n // gcd(h.n, h.d::hugeint))::bigint as high_n, (h.d // gcd(h.n, h.d::hugeint))::bigint as high_d, (l.n // gcd(l.n, l.d::hugeint))::bigint as low_n, (l.d // gcd(l.n, l.d::hugeint))::bigint as low_d from c""")
def q01b(t: Tables) -> DataFrame:
    """Amounts of up to 10^18 units: products and sums pass 64 bits."""
    rows = views.trades(t).withColumn("counter", F.col("counter") * BIG)
    out = markets.candles(rows, keys=["part"], ms=F.col("ms"), base="base", counter="counter", order=["ledger", "line"], resolution=WEEK, rationals=True)
    whole = lambda c: F.col(c).cast("decimal(38,0)").alias(c)
    parts = [F.col(f"{side}_r.{x}").alias(f"{side}_{x}") for side in ("high", "low") for x in "nd"]
    return out.select("part", "timestamp", "trade_count", whole("base_volume"), whole("counter_volume"), whole("high"), whole("low"), whole("average"), *parts)


KINDS_SQL = f"""{TRADES}, mv as (select ledger, case supp % 5 when 0 then 'transfer' when 1 then 'mint' when 2 then 'burn' when 3 then 'clawback' else 'fee' end as kind, 'h' || (supp % 50) as source, 'h' || (part % 50) as target, case when part % 11 > 0 then 'A' || (part % 7) end as asset, counter::hugeint * {BIG} as amount from tr),
lg as (select source as holder, asset, -amount as delta from mv where kind <> 'mint' and asset is not null union all select target, asset, amount from mv where kind in ('transfer', 'mint') and asset is not null)"""


@query("q15b_deltas_of_all_kinds", f"with {KINDS_SQL} select holder, asset, sum(delta)::decimal(38, 0) as delta from lg group by 1, 2 having sum(delta) <> 0")
def q15b(t: Tables) -> DataFrame:
    """Every kind of movement, events without an asset among them, and sums above 64 bits."""
    c = F.col
    kind = F.element_at(F.array(*[F.lit(k) for k in ("transfer", "mint", "burn", "clawback", "fee")]), (c("supp") % 5 + 1).cast("int"))
    holder = lambda x: F.concat(F.lit("h"), c(x) % 50)
    rows = views.trades(t).select(kind.alias("kind"), holder("supp").alias("source"), holder("part").alias("target"), F.when(c("part") % 11 > 0, F.concat(F.lit("A"), c("part") % 7)).alias("asset"), (c("counter") * BIG).alias("amount"))
    return deltas.summed(deltas.legs(rows), keys=["holder", "asset"]).select("holder", "asset", c("delta").cast("decimal(38,0)").alias("delta"))


def _starts(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").cast("long").alias("request"), F.concat(F.lit("a"), F.col("n_nationkey")).alias("asset"), (5 + F.col("n_nationkey") * 7).cast("long").alias("amount"))


def _pools(t: Tables) -> DataFrame:
    """A pool between each asset and the second next, whose reserves are gathered from all its parts; some are better than the offers and some worse."""
    c = F.col
    k = c("p_partkey")
    rows = t.part.groupBy((k % 40).alias("k")).agg(F.sum(200 + c("p_size") * 10).cast("long").alias("reserve_a"), F.sum(100 + k % 50 * 30).cast("long").alias("reserve_b"))
    return rows.select(F.concat(F.lit("a"), c("k")).alias("asset_a"), F.concat(F.lit("a"), (c("k") + 2) % 40).alias("asset_b"), "reserve_a", "reserve_b", F.lit(30).alias("fee_bps"))


POOLS = """po as (select 'a' || k as a, 'a' || ((k + 2) % 40) as b, ra, rb from (select p_partkey % 40 as k, sum(200 + p_size * 10)::bigint as ra, sum(100 + p_partkey % 50 * 30)::bigint as rb from part group by 1)),
ps as (select a as selling, b as buying, ra as rout, rb as rin from po union all select b, a, rb, ra from po)"""


def _path_sql(receive: bool, pools: bool, hops: int = 3, per_asset: int = 5) -> str:
    """The search unrolled: each hop from the ends that the one before improved."""
    way, better = ("asc", "<") if receive else ("desc", ">")
    parts = [LEVELS, *([POOLS] if pools else []), "f0 as (select n_nationkey::bigint as request, 'a' || n_nationkey as asset, (5 + n_nationkey * 7)::bigint as amount, 0 as hops, ['a' || n_nationkey] as path from nation)"]
    for h in range(1, hops + 1):
        if receive:
            book = f"select f.*, lv.buying as there, cb + ((f.amount - ab) * n + d - 1) // d as next from f{h - 1} f join lv on f.asset = lv.selling and f.amount > ab and f.amount <= ab + lv.amount"
            pool = f"select f.*, buying as there, (rin * 10000 * f.amount + (rout - f.amount) * 9970 - 1) // ((rout - f.amount) * 9970) as next from f{h - 1} f join ps on f.asset = ps.selling and f.amount < rout"
        else:
            book = f"select f.*, lv.selling as there, ab + least(lv.amount, ((f.amount - cb) * d) // n) as next from f{h - 1} f join lv on f.asset = lv.buying and f.amount > cb and f.amount <= cb + cost"
            pool = f"select f.*, selling as there, (9970 * f.amount * rout) // (rin * 10000 + 9970 * f.amount) as next from f{h - 1} f join ps on f.asset = ps.buying"
        known = " union all ".join(f"select request, asset, amount from f{i}" for i in range(h))
        pick = "min" if receive else "max"
        parts += [
            f"s{h} as ({book}{' union all ' + pool if pools else ''})",
            f"c{h} as (select request, asset as src, there, {pick}(next) as next, any_value(path) as path from s{h} where not list_contains(path, there) and next > 0 group by request, asset, there)",
            f"b{h} as (select request, asset as there, {pick}(amount) as before from ({known}) group by 1, 2)",
            f"i{h} as (select c{h}.*, before, {pick}(next) over (partition by request, there order by src rows between unbounded preceding and 1 preceding) as so_far from c{h} left join b{h} using (request, there))",
            f"e{h} as (select request, there as asset, next as amount, {h} as hops, list_append(path, there) as path from i{h} where (before is null or next {better} before) and (so_far is null or next {better} so_far))",
            f"f{h} as (select * from e{h} qualify row_number() over (partition by request, asset order by amount {way}) = 1)",
        ]
    every = " union all ".join(["select * from f0", *(f"select * from e{i}" for i in range(1, hops + 1))])
    return f"with {', '.join(parts)}, z as (select *, row_number() over (partition by request, asset order by amount {way}, hops, array_to_string(path, '>')) as k from ({every})) select request, asset, amount, hops, array_to_string(path, '>') as path from z where k <= {per_asset}"


def _paths(t: Tables, *, receive: bool, pools: bool) -> DataFrame:
    found = paths.find_paths(paths.levels(views.offers(t)), _starts(t), receive=receive, max_hops=3, per_asset=5, pools=_pools(t) if pools else None)
    return found.select("request", "asset", "amount", "hops", F.array_join("path", ">").alias("path"))


@query("q49_paths_receive", _path_sql(True, False))
def q49(t: Tables) -> DataFrame:
    return _paths(t, receive=True, pools=False)


@query("q49b_paths_send", _path_sql(False, False))
def q49b(t: Tables) -> DataFrame:
    return _paths(t, receive=False, pools=False)


@query("q49c_paths_receive_with_pools", _path_sql(True, True))
def q49c(t: Tables) -> DataFrame:
    return _paths(t, receive=True, pools=True)


@query("q49d_paths_send_with_pools", _path_sql(False, True))
def q49d(t: Tables) -> DataFrame:
    return _paths(t, receive=False, pools=True)


VENUES = f"""{LEVELS}, {POOLS}, w as (select selling, buying, rout, rin, unnest([5, 40, 90]) as need from ps)"""


@query("q49e_pool_or_book", f"with {VENUES}, b as (select w.selling, w.buying, need, min(cb + ((need - ab) * n + d - 1) // d) as book from w join lv on lv.selling = w.selling and lv.buying = w.buying and need > ab and need <= ab + amount group by 1, 2, 3), p as (select selling, buying, need, (rin * 10000 * need + (rout - need) * 9970 - 1) // ((rout - need) * 9970) as pool from w where need < rout) select selling, buying, need, book, pool, case when book is null or pool < book then 'pool' else 'book' end as venue from p left join b using (selling, buying, need)")
def q49e(t: Tables) -> DataFrame:
    """For every pool and three amounts, whether the pool or the offers of its pair ask less."""
    sides = paths.pool_sides(_pools(t))
    wants = sides.select("selling", "buying", F.explode(F.array(*[F.lit(n).cast("long") for n in (5, 40, 90)])).alias("need")).select(F.col("selling").alias("asset"), F.col("buying").alias("pair"), "need")
    book = paths.bought(wants, scratch.written(paths.levels(views.offers(t)), "levels"), need="need").where("there = pair").select("asset", "pair", "need", F.col("next").alias("book"))
    pool = paths.pool_trade(wants, sides, receive=True, amount="need").where("there = pair").select("asset", "pair", "need", F.col("next").alias("pool"))
    both = pool.join(book, ["asset", "pair", "need"], "left")
    return both.select(F.col("asset").alias("selling"), F.col("pair").alias("buying"), F.col("need").cast("int").alias("need"), "book", "pool", F.when(F.col("book").isNull() | (F.col("pool") < F.col("book")), F.lit("pool")).otherwise(F.lit("book")).alias("venue"))


@query("q48c_proceeds", f"with {LEVELS}, p as (select distinct selling, buying from o), x as (select p.selling, p.buying, ab + least(amount, ((60 - cb) * d) // n) as got from p left join lv on lv.selling = p.selling and lv.buying = p.buying and 60 > cb and 60 <= cb + cost) select selling, buying, case when got > 0 then got end as got from x")
def q48c(t: Tables) -> DataFrame:
    """What 60 units buy in each pair; null where its offers cannot take them all."""
    level = scratch.written(paths.levels(views.offers(t)), "levels")
    got = paths.sold(level.select("buying", F.lit(60).cast("long").alias("amount")).distinct().withColumnRenamed("buying", "given"), level, asset="given").select(F.col("given").alias("buying"), F.col("there").alias("selling"), F.col("next").alias("summed"))
    return level.select("selling", "buying").distinct().join(got.withColumnRenamed("summed", "got"), ["selling", "buying"], "left")


TYPES = ["payment", "create_account", "account_merge", "create_claimable_balance", "claim_claimable_balance", "clawback", "clawback_claimable_balance", "inflation", "manage_buy_offer", "manage_sell_offer", "create_passive_sell_offer", "path_payment_strict_send", "path_payment_strict_receive", "set_options"]
_TYPE_LIST = "[" + ", ".join(f"'{x}'" for x in TYPES) + "]"
MOVES_SQL = f"""with {TRADES}, o as (select ledger, part as tx_index, line as op_index, base % 5 <> 0 as ok, {_TYPE_LIST}[supp % 14 + 1] as type, 'h' || (supp % 9) as src, 'h' || (part % 9) as dst, 'b' || ledger as bal, case when part % 6 = 0 then 'native' else 'A' || (part % 4) || ':h' || (part % 4) end as asset, 'B:h' || (ledger % 9) as sold, case when base % 7 > 0 then counter end as amount, base from tr),
m as (
 select ledger, tx_index, op_index, 0 as leg, src as source, case when type = 'create_claimable_balance' then bal else dst end as target, case when type in ('create_account', 'account_merge') then 'native' else asset end as asset, amount, null as kind from o where ok and type in ('payment', 'create_account', 'account_merge', 'create_claimable_balance') and amount is not null
 union all select ledger, tx_index, op_index, 0, bal, src, asset, amount, null from o where ok and type = 'claim_claimable_balance' and amount is not null
 union all select ledger, tx_index, op_index, 0, case when type = 'clawback' then dst else bal end, null, asset, amount, 'clawback' from o where ok and type in ('clawback', 'clawback_claimable_balance') and amount is not null
 union all select ledger, tx_index, op_index, k, null, 'h' || k, 'native', base + k, 'mint' from o, (select unnest([0, 1]) as k) where ok and type = 'inflation'
 union all select ledger, tx_index, op_index, 0, 'h8', src, sold, base, null from o where ok and type in ({', '.join(f"'{x}'" for x in transfers.TRADING)})
 union all select ledger, tx_index, op_index, 1, src, 'h8', asset, base * 2, null from o where ok and type in ({', '.join(f"'{x}'" for x in transfers.TRADING)})
 union all select ledger, tx_index, op_index, 2, src, dst, asset, amount, null from o where ok and type like 'path_payment%' and amount is not null),
i as (select *, case when asset like '%:%' then split_part(asset, ':', 2) end as issuer from m)
select ledger, tx_index, op_index, leg, coalesce(kind, case when source = issuer and target is distinct from issuer then 'mint' when target = issuer and source is distinct from issuer then 'burn' else 'transfer' end) as kind, source, target, asset, amount from i"""


@query("q68b_movements_of_all_operations", MOVES_SQL)
def q68b(t: Tables) -> DataFrame:
    c = F.col
    holder = lambda x: F.concat(F.lit("h"), x)
    asset = F.when(c("part") % 6 == 0, F.lit("native")).otherwise(F.concat(F.lit("A"), c("part") % 4, F.lit(":h"), c("part") % 4))
    kind = F.element_at(F.array(*[F.lit(x) for x in TYPES]), (c("supp") % 14 + 1).cast("int"))
    atoms = F.array(F.struct(F.lit("h8").alias("seller"), F.concat(F.lit("B:h"), c("ledger") % 9).alias("sold"), c("base").alias("sold_amount"), asset.alias("bought"), (c("base") * 2).alias("bought_amount")))
    payouts = F.array(*[F.struct(F.lit(f"h{k}").alias("destination"), (c("base") + k).alias("amount")) for k in (0, 1)])
    ops = views.trades(t).select("ledger", c("part").alias("tx_index"), c("line").alias("op_index"), (c("base") % 5 != 0).alias("tx_successful"), kind.alias("type"), holder(c("supp") % 9).alias("op_source"), holder(c("part") % 9).alias("destination"), F.concat(F.lit("b"), c("ledger")).alias("balance_id"), asset.alias("asset"), F.when(c("base") % 7 > 0, c("counter")).alias("amount"), atoms.alias("atoms"), payouts.alias("payouts"))
    return transfers.all_movements(ops)


@query("q79_pool_movements", f"with {TRADES}, o as (select ledger, part, line, supp % 2 = 0 as deposit, 'h' || supp as src, 'p' || (part % 5) as pool, base as a, case when supp % 2 = 0 then counter else counter % 3 end as b from tr where base > 0) select ledger, part as tx_index, line as op_index, 'transfer' as kind, case when deposit then src else pool end as source, case when deposit then pool else src end as target, asset, amount from (select *, 'x' as asset, a as amount from o union all select *, 'y', b from o) where amount > 0")
def q79(t: Tables) -> DataFrame:
    c = F.col
    into = c("supp") % 2 == 0
    ops = views.trades(t).where("base > 0").select("ledger", c("part").alias("tx_index"), c("line").alias("op_index"), F.lit(True).alias("tx_successful"), F.when(into, F.lit("pool_deposit")).otherwise(F.lit("pool_withdraw")).alias("type"), F.concat(F.lit("h"), c("supp")).alias("op_source"), F.concat(F.lit("p"), c("part") % 5).alias("pool_id"), F.lit("x").alias("asset_a"), c("base").alias("amount_a"), F.lit("y").alias("asset_b"), F.when(into, c("counter")).otherwise(c("counter") % 3).alias("amount_b"))
    return transfers.pool_movements(ops)


@query("q80_fee_movements", "with x as (select o_orderkey as ledger, o_custkey as tx_index, 'c' || o_custkey as source, cast(round(o_totalprice * 100) as bigint) as charged, o_orderkey % 3 * 100 as refund from orders) select ledger, 'fee' as step, tx_index, source, charged as amount from x union all select ledger, 'refund', tx_index, source, -refund from x where refund > 0")
def q80(t: Tables) -> DataFrame:
    c = F.col
    txs = t.orders.select(c("o_orderkey").alias("ledger"), F.lit(23).alias("protocol"), c("o_custkey").alias("tx_index"), F.concat(F.lit("c"), c("o_custkey")).alias("tx_source"), views.cents("o_totalprice").alias("fee_charged"), (c("o_orderkey") % 3 * 100).alias("fee_refund"))
    return transfers.fee_movements(txs).select("ledger", "step", "tx_index", "source", "amount")


@query("q80b_payee_marks", "select o_orderkey, case when o_custkey % 7 = 0 then 'id' when o_orderkey % 4 = 1 then 'text' when o_orderkey % 4 = 2 then 'id' when o_orderkey % 4 = 3 then 'hash' end as kind, case when o_custkey % 7 = 0 then (o_custkey * 3)::varchar when o_orderkey % 4 = 1 then o_orderpriority when o_orderkey % 4 = 2 then o_custkey::varchar when o_orderkey % 4 = 3 then base64(encode(o_orderpriority)) end as value from orders")
def q80b(t: Tables) -> DataFrame:
    c = F.col
    kind = F.element_at(F.array(*[F.lit(k) for k in ("none", "text", "id", "hash")]), (c("o_orderkey") % 4 + 1).cast("int"))
    info = transfers.muxed_info(kind, c("o_orderpriority"), c("o_custkey"), F.encode("o_orderpriority", "UTF-8"), muxed_id=F.when(c("o_custkey") % 7 == 0, c("o_custkey") * 3))
    return t.orders.select("o_orderkey", info.alias("i")).select("o_orderkey", "i.kind", "i.value")


@query(
    "q22b_asset_report",
    """with r as (select 'A' || (c_custkey % 40) as asset, ['authorized', 'maintain', 'unauthorized', 'other'][c_custkey % 4 + 1] as class, round(c_acctbal * 100)::hugeint as amount from customer
 union all select 'A' || (o_custkey % 40), 'claimable', round(o_totalprice * 100)::hugeint from orders
 union all select 'A' || (p_partkey % 40), 'pool', p_size::hugeint from part union all select case when p_partkey % 9 = 0 then 'native' else 'A' || ((p_partkey + 1) % 40) end, 'pool', p_partkey::hugeint from part
 union all select 'A' || (l_partkey % 50), 'contract', l_partkey::hugeint * 1000000000000000000 from lineitem)
select asset, """
    + ", ".join(f"count(*) filter (where class = '{k}') as n_{k}, coalesce(sum(amount) filter (where class = '{k}'), 0)::decimal(38, 0) as amount_{k}" for k in ("authorized", "maintain", "unauthorized", "claimable", "pool", "contract"))
    + " from r where asset <> 'native' and class <> 'other' group by 1",
)
def q22b(t: Tables) -> DataFrame:
    """Holders of assets of every kind; balances of contracts pass 64 bits."""
    c = F.col
    name = lambda k, m=40: F.concat(F.lit("A"), k % m)
    status = F.element_at(F.array(*[F.lit(x) for x in ("authorized", "maintain", "unauthorized", "other")]), (c("c_custkey") % 4 + 1).cast("int"))
    lines = t.customer.select(name(c("c_custkey")).alias("asset"), status.alias("status"), views.cents("c_acctbal").alias("balance"))
    claimables = t.orders.select(name(c("o_custkey")).alias("asset"), views.cents("o_totalprice").alias("amount"))
    k = c("p_partkey")
    pools = t.part.select(name(k).alias("asset_a"), F.when(k % 9 == 0, "native").otherwise(name(k + 1)).alias("asset_b"), c("p_size").cast("long").alias("reserve_a"), k.alias("reserve_b"))
    contracts = t.lineitem.select(name(c("l_partkey"), 50).alias("asset"), (c("l_partkey").cast("decimal(18,0)") * F.lit(10**18).cast("decimal(19,0)")).alias("amount"))
    return markets.asset_report(lines, claimables, pools, contracts)


@query(
    "q18b_counter_faults",
    """with n as (select l_orderkey as k, count(*) as ops, count(*) filter (where l_returnflag = 'R') as good from lineitem group by 1),
s as (select o_orderkey as k, coalesce(ops, 0) + case when o_orderkey % 97 = 0 then 1 else 0 end as ops, coalesce(good, 0) + case when o_orderkey % 89 = 0 then 2 else 0 end as good from orders left join n on k = o_orderkey where o_orderkey % 101 > 0),
j as (select coalesce(s.k, n.k) as k, s.ops as so, n.ops as no, s.good as sg, n.good as ng from s full join n on s.k = n.k)
select k, 'ops' as counter, so as stated, coalesce(no, 0) as counted from j where so is distinct from coalesce(no, 0) union all select k, 'good', sg, coalesce(ng, 0) from j where sg is distinct from coalesce(ng, 0)""",
)
def q18b(t: Tables) -> DataFrame:
    """Counters that ledgers state against the operations counted; some are off, some ledgers are not there."""
    c = F.col
    counted = t.lineitem.groupBy(c("l_orderkey").alias("k")).agg(F.count("*").alias("ops"), F.count_if(c("l_returnflag") == "R").alias("good"))
    k = c("o_orderkey")
    stated = t.orders.where(k % 101 > 0).select(k.alias("k")).join(counted, "k", "left")
    more = lambda n, m, x: (F.coalesce(n, F.lit(0)) + F.when(c("k") % m == 0, x).otherwise(0)).alias(n)
    return markets.counter_faults(stated.select("k", more("ops", 97, 1), more("good", 89, 2)), counted, keys=["k"], counters=["ops", "good"])


@query(
    "q21c_pool_faults",
    """with p as (select 'P' || (case when p_partkey % 31 = 0 then 0 else p_partkey end) as pool_id, case when p_partkey % 11 = 0 then 'Z' else 'A' || (p_partkey % 500) end as a, 'B' || (p_partkey % 700) as b, case when p_partkey % 13 = 0 then -1 else p_size end as ra, case when p_partkey % 17 = 0 then null else 5 end as rb, case when p_partkey % 19 = 0 then 25 else 30 end as fee from part)
select distinct pool_id, 'order of assets' as fault from p where a >= b union all select distinct pool_id, 'reserve' from p where ra < 0 or rb is null union all select distinct pool_id, 'fee' from p where fee <> 30
union all select pool_id, 'several pools' from p group by 1 having count(*) > 1 union all select min(pool_id), 'several pools of a pair' from p group by least(a, b), greatest(a, b) having count(distinct pool_id) > 1""",
)
def q21c(t: Tables) -> DataFrame:
    """Pools with planted faults of every kind."""
    c = F.col
    k = c("p_partkey")
    a, b = F.when(k % 11 == 0, "Z").otherwise(F.concat(F.lit("A"), k % 500)), F.concat(F.lit("B"), k % 700)
    rows = t.part.select(F.concat(F.lit("P"), F.when(k % 31 == 0, 0).otherwise(k)).alias("pool_id"), a.alias("asset_a"), b.alias("asset_b"), F.when(k % 13 == 0, -1).otherwise(c("p_size")).alias("reserve_a"), F.when(k % 17 > 0, 5).alias("reserve_b"), F.when(k % 19 == 0, 25).otherwise(30).alias("fee_bps"))
    return markets.pool_faults(rows)


@query(
    "q21d_level_faults",
    f"""with {LEVELS}, m as (select selling, buying, n // gcd(n, d) as n, d // gcd(n, d) as d, count(*) as k, sum(amount)::bigint as s from (select selling, buying, amount, n, d from o) group by 1, 2, 3, 4)
select selling, buying, n, d, k as made_offers, s as made_amount, case when (k * 7 + s) % 5 > 0 then k end as held_offers, case when (k * 7 + s) % 5 > 0 then s + 1 end as held_amount from m where (k * 7 + s) % 3 = 0 or (k * 7 + s) % 5 = 0""",
)
def q21d(t: Tables) -> DataFrame:
    """An index of price levels held against its offers: every fifth level is missing, every third has another amount."""
    c = F.col
    offers = views.offers(t).where("amount > 0")
    none = offers.limit(0).select("selling", "buying", "n", "d", F.lit(0).alias("offers"), "amount")
    made = markets.level_faults(offers, none).select("selling", "buying", "n", "d", c("made_offers").alias("offers"), c("made_amount").alias("amount"))
    code = (c("offers") * 7 + c("amount")) % 15
    held = made.where(code % 5 > 0).withColumn("amount", F.when(code % 3 == 0, c("amount") + 1).otherwise(c("amount")))
    out = markets.level_faults(offers, held)
    return out.select("selling", "buying", "n", "d", "made_offers", c("made_amount").cast("long").alias("made_amount"), "held_offers", c("held_amount").cast("long").alias("held_amount"))


@query(
    "q69b_entry_deltas",
    """with o as (select o_orderkey as k, o_custkey as cust, round(o_totalprice * 100)::hugeint as amount, ['account', 'trustline', 'claimable_balance', 'liquidity_pool', 'offer'][o_orderkey % 5 + 1] as type from orders),
b as (select k, type, 'h' || cust as holder, case type when 'account' then 'native' else 'A' || (cust % 3) end as asset, amount, 1 as f from o where type in ('account', 'trustline', 'claimable_balance') and not (type = 'trustline' and k % 7 = 0)
 union all select k, type, 'h' || cust, 'A', amount, 1 from o where type = 'liquidity_pool' union all select k, type, 'h' || cust, 'B', amount, 2 from o where type = 'liquidity_pool'),
d as (select holder, asset, f * case k % 3 when 0 then amount when 1 then -amount else amount - (amount // 2) end as delta from b)
select holder, asset, sum(delta)::decimal(38, 0) as delta from d group by 1, 2 having sum(delta) <> 0""",
)
def q69b(t: Tables) -> DataFrame:
    """Deltas of accounts, trust lines, claimable balances and pools, from entries that appear, go and change."""
    c = F.col
    k, cust, amount = c("o_orderkey"), c("o_custkey"), views.cents("o_totalprice")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("account", "trustline", "claimable_balance", "liquidity_pool", "offer")]), (k % 5 + 1).cast("int"))
    who, asset = F.concat(F.lit("h"), cust), F.concat(F.lit("A"), cust % 3)
    entry = lambda x: F.struct(kind.alias("type"), who.alias("account_id"), x.alias("balance"), F.when((kind != "trustline") | (k % 7 > 0), asset).alias("asset"), who.alias("balance_id"), x.alias("amount"), who.alias("pool_id"), F.lit("A").alias("asset_a"), F.lit("B").alias("asset_b"), x.alias("reserve_a"), (x * 2).alias("reserve_b"))
    half = F.floor(amount / 2).cast("long")
    rows = t.orders.select(F.when(k % 3 == 1, entry(amount)).when(k % 3 == 2, entry(half)).alias("pre"), F.when(k % 3 != 1, entry(amount)).alias("post"))
    return deltas.entry_deltas(rows).select("holder", "asset", c("delta").cast("decimal(38,0)").alias("delta"))


@query(
    "q68c_claimed_balances",
    """with g as (select l_orderkey as ledger, l_linenumber as op_index, count(*) filter (where l_partkey % 3 = 0 and l_suppkey % 2 = 0) as n, max(case when l_partkey % 3 = 0 and l_suppkey % 2 = 0 then l_partkey end) as part from lineitem group by 1, 2)
select ledger, 1 as tx_index, op_index, case when n = 1 then 'b' || part end as balance_id, case when n = 1 then part * 10 end as amount, case when n = 0 then 'no balance is removed' when n > 1 then 'several balances are removed' end as wrong from g""",
)
def q68c(t: Tables) -> DataFrame:
    """Claims by the balance that each removed; operations that removed none or several are named."""
    c = F.col
    part = c("l_partkey")
    rows = t.lineitem.select(c("l_orderkey").alias("ledger"), F.lit(1).alias("tx_index"), c("l_linenumber").alias("op_index"), F.when(part % 3 == 0, "claimable_balance").otherwise("account").alias("type"), F.when(c("l_suppkey") % 2 == 0, "removed").otherwise("updated").alias("kind"), F.concat(F.lit("b"), part).alias("balance_id"), F.lit("A").alias("asset"), (part * 10).alias("amount"))
    return transfers.claimed_balances(rows, on_error="mark").drop("asset")
