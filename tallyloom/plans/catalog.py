"""One query for each operator, over the star-schema tables seen as ledger data."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.functions import assets, ids, money, timing
from tallyloom.operators import archives, changes as ch, deltas, event_filters as ev, fees, flatten, markets, paging, paths, snapshot, transfers
from tallyloom.plans import views
from tallyloom.plans.registry import Tables, query
from tallyloom.plans.views import CHANGES, LEVELS, OP_IDS, POS, TRADES
from tallyloom.sinks import scratch, tables
from tallyloom.sources import lake
from tallyloom.streaming import ledger_stream

WEEK, DAY = markets.RESOLUTIONS["1w"], markets.RESOLUTIONS["1d"]


def _longs(df: DataFrame) -> DataFrame:
    """Decimals as longs, where the tables' values allow it."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.simpleString().startswith("decimal") else F.col(f.name) for f in df.schema.fields])


def _candle_sql(resolution: int, offset: int) -> str:
    return f"""with {TRADES}, p as (select *, (counter * 10000000) // base as price, ((ms - {offset}) // {resolution}) * {resolution} + {offset} as bucket from tr where base > 0)
select part, bucket as "timestamp", count(*) as trade_count, sum(base)::bigint as base_volume, sum(counter)::bigint as counter_volume, max(price) as high, min(price) as low,
       first(price order by ms, ledger, line) as open, last(price order by ms, ledger, line) as close, (sum(counter)::bigint * 10000000) // sum(base)::bigint as average
from p group by part, bucket"""


@query("q01_candles", _candle_sql(WEEK, 0))
def q01(t: Tables) -> DataFrame:
    return _longs(markets.candles(views.trades(t), keys=["part"], ms=F.col("ms"), base="base", counter="counter", order=["ledger", "line"], resolution=WEEK))


@query("q02_candles_offset", _candle_sql(WEEK, DAY))
def q02(t: Tables) -> DataFrame:
    return _longs(markets.candles(views.trades(t), keys=["part"], ms=F.col("ms"), base="base", counter="counter", order=["ledger", "line"], resolution=WEEK, offset=DAY))


@query("q03_positions", f"with {OP_IDS} select {POS} as position, ledger, tx, op, ledger * 4294967296 + 4294967295 as after_ledger, case when op = 4095 then (ledger + 1) * 4294967296 else {POS} + 1 end as next_op from oi")
def q03(t: Tables) -> DataFrame:
    p = views.op_ids(t).select(ids.position(F.col("ledger"), F.col("tx"), F.col("op")).alias("position"))
    c = F.col("position")
    return p.select("position", ids.ledger_of(c).alias("ledger"), ids.tx_of(c).alias("tx"), ids.op_of(c).alias("op"), ids.after_ledger(ids.ledger_of(c)).alias("after_ledger"), ids.next_op(c).alias("next_op"))


@query("q04_cursors", f"with {OP_IDS} select printf('%019d-%010d', {POS}, supp) as cursor, {POS} as position, supp as index from oi")
def q04(t: Tables) -> DataFrame:
    rows = views.op_ids(t).select(ids.cursor(ids.position(F.col("ledger"), F.col("tx"), F.col("op")), F.col("supp")).alias("cursor"))
    position, index = ids.cursor_parts(F.col("cursor"))
    return rows.select("cursor", position.alias("position"), index.alias("index"))


@query("q05_page", f"with {OP_IDS} select {POS} as position, supp from oi where {POS} > 500 * 4294967296 order by position limit 50")
def q05(t: Tables) -> DataFrame:
    rows = views.op_ids(t).withColumn("position", ids.position(F.col("ledger"), F.col("tx"), F.col("op")))
    return paging.page(rows, key=F.col("position"), after=500 << 32, limit=50, implied=F.col("ledger") >= 500).select("position", "supp")


@query("q06_page_back", f"with {OP_IDS} select {POS} as position, supp from oi where {POS} < 500 * 4294967296 order by position desc limit 50")
def q06(t: Tables) -> DataFrame:
    rows = views.op_ids(t).withColumn("position", ids.position(F.col("ledger"), F.col("tx"), F.col("op")))
    return paging.page(rows, key=F.col("position"), after=500 << 32, limit=50, descending=True, implied=F.col("ledger") < 500).select("position", "supp")


KEYS_SQL = """k as (select o_orderkey as sequence,
  printf('%08X--%d-%d', 4294967295 - o_orderkey // 640 * 640, o_orderkey // 640 * 640, o_orderkey // 640 * 640 + 639) || '/' ||
  printf('%08X--%d-%d.xdr.zst', 4294967295 - o_orderkey // 64 * 64, o_orderkey // 64 * 64, o_orderkey // 64 * 64 + 63) as key from orders)"""


def _keys(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("sequence"), ids.object_key(F.col("o_orderkey"), per_file=64, files_per_partition=10).alias("key"))


@query("q07_object_keys", f"with {KEYS_SQL} select * from k")
def q07(t: Tables) -> DataFrame:
    return _keys(t)


@query("q08_key_ranges", f"with {KEYS_SQL}, d as (select distinct key as path from k) select path, regexp_extract(path, '--([0-9]+)-([0-9]+)\\.xdr', 1)::bigint as first, regexp_extract(path, '--([0-9]+)-([0-9]+)\\.xdr', 2)::bigint as last from d where regexp_extract(path, '--([0-9]+)-([0-9]+)\\.xdr', 2)::bigint >= 1000 and regexp_extract(path, '--([0-9]+)-([0-9]+)\\.xdr', 1)::bigint <= 9000")
def q08(t: Tables) -> DataFrame:
    return lake.covering(lake.ledger_files(_keys(t).select(F.col("key").alias("path")).distinct()), low=1000, high=9000)


@query("q09_live_state", f"with {CHANGES}, r as (select *, row_number() over (partition by user_id order by ms desc, event_id desc) as k from ch) select event_id, user_id, ms, kind, value from r where k = 1 and kind <> 'removed'")
def q09(t: Tables) -> DataFrame:
    rows = views.changes(t).select("event_id", "user_id", "ms", "kind", "value")
    return snapshot.newest(rows, keys=["user_id"], newest_first=[-F.col("ms"), -F.col("event_id")], dead=F.col("kind") == "removed")


@query("q10_filter_below_dedup", f"with {CHANGES}, f as (select * from ch where value > 5000), r as (select *, row_number() over (partition by user_id order by ms desc, event_id desc) as k from f) select event_id, user_id, kind, value from r where k = 1 and kind <> 'removed'")
def q10(t: Tables) -> DataFrame:
    rows = views.changes(t)
    return snapshot.newest(rows, keys=["user_id"], newest_first=[-F.col("ms"), -F.col("event_id")], dead=F.col("kind") == "removed", keep=F.col("value") > 5000).select("event_id", "user_id", "kind", "value")


@query("q11_archived_state", f"with {CHANGES}, r as (select *, row_number() over (partition by user_id order by ms desc, event_id desc) as k from ch) select event_id, user_id, kind, value from r where k = 1 and kind = 'removed'")
def q11(t: Tables) -> DataFrame:
    rows = views.changes(t)
    return snapshot.archived(rows, keys=["user_id"], newest_first=[-F.col("ms"), -F.col("event_id")], is_archived=F.col("kind") == "removed").select("event_id", "user_id", "kind", "value")


COMPACT_SQL = f"""with recursive {CHANGES},
c as (select user_id, day, kind, case when kind = 'created' then null else value end as pre, case when kind = 'removed' then null else value end as post,
      row_number() over (partition by user_id, day order by ms, event_id) as k from ch),
f(user_id, day, k, kind, pre, post) as (
  select user_id, day, k, kind, pre, post from c where k = 1
  union all
  select c.user_id, c.day, c.k,
    case when f.kind = 'error' then 'error' when f.kind is null then c.kind
         when c.kind = 'updated' and f.kind in ('created', 'updated') then f.kind
         when c.kind = 'removed' and f.kind = 'created' then null when c.kind = 'removed' and f.kind = 'updated' then 'removed'
         when c.kind = 'created' and f.kind = 'removed' then 'updated' else 'error' end,
    case when f.kind = 'error' then f.pre when f.kind is null then c.pre
         when c.kind = 'updated' and f.kind in ('created', 'updated') then f.pre
         when c.kind = 'removed' and f.kind = 'updated' then f.pre when c.kind = 'created' and f.kind = 'removed' then f.pre end,
    case when f.kind = 'error' then f.post when f.kind is null then c.post
         when c.kind = 'updated' and f.kind in ('created', 'updated') then c.post
         when c.kind = 'created' and f.kind = 'removed' then c.post end
  from f join c on c.user_id = f.user_id and c.day = f.day and c.k = f.k + 1),
l as (select *, row_number() over (partition by user_id, day order by k desc) as r from f)
select user_id, day, kind, pre, post from l where r = 1 and kind is not null"""


@query("q12_compaction", COMPACT_SQL)
def q12(t: Tables) -> DataFrame:
    rows = views.changes(t).select("user_id", "day", "ms", "event_id", "kind", F.when(F.col("kind") != "created", F.col("value")).alias("pre"), F.when(F.col("kind") != "removed", F.col("value")).alias("post"))
    return ch.compacted(rows, keys=["user_id", "day"], order=["ms", "event_id"], on_error="mark")


@query("q13_pairing", f"with {CHANGES} select event_id, user_id, lag(value) over (partition by user_id order by ms, event_id) as pre, value as post from ch")
def q13(t: Tables) -> DataFrame:
    return ch.paired(views.changes(t), keys=["user_id"], order=["ms", "event_id"], value="value").select("event_id", "user_id", "pre", "post")


@query("q14_change_order", f"""with {TRADES} select ledger, line, row_number() over (partition by ledger order by supp % 4, part % 3,
  case when supp % 2 = 0 and line % 3 > 0 then 1 else 0 end, part, line % 3, line, cast(part as varchar), counter) as place from tr""")
def q14(t: Tables) -> DataFrame:
    rows = views.trades(t).select("ledger", "line", (F.col("supp") % 4).alias("stage"), (F.col("part") % 3).alias("phase"), (F.col("supp") % 2 == 0).alias("parallel"), F.col("part").alias("tx_index"), F.col("line").alias("op_index"), (F.col("line") % 3).alias("part"), F.col("part").cast("string").alias("key"), F.col("counter").alias("ord"))
    return ch.change_order(rows).select("ledger", "line", "place")


def _moves(t: Tables) -> DataFrame:
    tr = views.trades(t).join(t.orders.select(F.col("o_orderkey").alias("ledger"), F.col("o_custkey").alias("cust")), "ledger")
    return tr.select("ledger", F.lit("transfer").alias("kind"), F.concat(F.lit("c"), F.col("cust")).alias("source"), F.concat(F.lit("s"), F.col("supp")).alias("target"), (F.col("part") % 10).cast("string").alias("asset"), F.col("counter").alias("amount"))


MOVES = f"{TRADES}, mv as (select tr.ledger, 'c' || o_custkey as source, 's' || supp as target, cast(part % 10 as varchar) as asset, counter as amount from tr join orders on o_orderkey = tr.ledger)"
LEGS = "lg as (select ledger, source as holder, asset, -amount as delta from mv union all select ledger, target, asset, amount from mv)"


@query("q15_event_deltas", f"with {MOVES}, {LEGS} select holder, asset, sum(delta)::bigint as delta from lg group by holder, asset having sum(delta) <> 0")
def q15(t: Tables) -> DataFrame:
    return _longs(deltas.summed(deltas.legs(_moves(t)), keys=["holder", "asset"]))


@query("q16_delta_mismatch", f"with {MOVES}, {LEGS}, a as (select holder, asset, sum(delta)::bigint as delta from lg group by 1, 2 having sum(delta) <> 0), b as (select holder, asset, sum(delta)::bigint as delta from lg where ledger % 97 <> 0 group by 1, 2 having sum(delta) <> 0) select holder, asset, a.delta as left_value, b.delta as right_value from a full join b using (holder, asset) where a.delta is distinct from b.delta")
def q16(t: Tables) -> DataFrame:
    moves = _moves(t)
    keys = ["holder", "asset"]
    return _longs(deltas.mismatches(deltas.summed(deltas.legs(moves), keys=keys), deltas.summed(deltas.legs(moves.where("ledger % 97 <> 0")), keys=keys), keys=keys))


@query("q17_reconciliation", f"with {MOVES}, {LEGS}, a as (select holder, asset, sum(delta)::bigint as delta from lg group by 1, 2 having sum(delta) <> 0), b as (select holder, asset, sum(delta)::bigint as delta from lg where ledger % 97 <> 0 group by 1, 2 having sum(delta) <> 0), d as (select holder, asset, coalesce(a.delta, 0) - coalesce(b.delta, 0) as diff from a full join b using (holder, asset)) select holder, asset, case when diff > 0 then 'mint' else 'burn' end as kind, abs(diff) as amount, case when diff > 0 then 0 else 2 end as place from d where diff <> 0")
def q17(t: Tables) -> DataFrame:
    moves = _moves(t)
    keys = ["holder", "asset"]
    return _longs(deltas.reconciled(deltas.summed(deltas.legs(moves), keys=keys), deltas.summed(deltas.legs(moves.where("ledger % 97 <> 0")), keys=keys), keys=keys))


@query("q18_ledger_counts", "with o as (select l_orderkey, count(*) as ops from lineitem group by 1) select cast(o_orderdate as date) as day, count(*) filter (where o_orderstatus = 'F') as good_txs, count(*) as all_txs, coalesce(sum(ops) filter (where o_orderstatus = 'F'), 0)::bigint as good_ops, sum(ops)::bigint as all_ops from orders join o on l_orderkey = o_orderkey group by 1")
def q18(t: Tables) -> DataFrame:
    ops = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("ops"))
    txs = t.orders.join(ops, "o_orderkey").withColumn("day", F.to_date("o_orderdate"))
    return markets.ledger_counts(txs, keys=["day"], success=F.col("o_orderstatus") == "F", operations=F.col("ops"))


_PCT = ", ".join(f"quantile_disc(fee, {p / 100})::bigint as p{p}" for p in fees.PERCENTILES)


@query("q19_fee_distribution", f"with f as (select l_returnflag, cast(l_quantity as bigint) as fee from lineitem), m as (select l_returnflag, fee, row_number() over (partition by l_returnflag order by count(*) desc, fee) as k from f group by 1, 2), u as (select l_returnflag, fee as usual from m where k = 1) select l_returnflag, count(fee) as n, min(fee) as least, max(fee) as most, any_value(usual) as usual, {_PCT} from f join u using (l_returnflag) group by l_returnflag")
def q19(t: Tables) -> DataFrame:
    return fees.distribution(t.lineitem.select("l_returnflag", F.col("l_quantity").cast("long").alias("fee")), keys=["l_returnflag"], fee="fee")


@query("q20_fee_classes", "with o as (select l_orderkey, count(*) as ops from lineitem group by 1), b as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as charged, coalesce(ops, 0) as ops, o_orderstatus = 'O' as contract, cast(round(o_totalprice * 100) as bigint) // 3 as resource from orders left join o on l_orderkey = o_orderkey) select o_orderkey, case when contract then 'inclusion' when ops > 0 then 'classic' end as bucket, case when contract then charged - resource when ops > 0 then charged // ops end as fee from b")
def q20(t: Tables) -> DataFrame:
    ops = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("ops"))
    rows = t.orders.join(ops, "o_orderkey", "left").withColumn("charged", views.cents("o_totalprice")).withColumn("resource", F.expr("charged div 3"))
    found = fees.fee_bucket(charged=F.col("charged"), operations=F.coalesce("ops", F.lit(0)), contract=F.col("o_orderstatus") == "O", resource=F.col("resource"))
    return rows.select("o_orderkey", found.alias("f")).select("o_orderkey", "f.bucket", "f.fee")


@query("q21_order_book", f"with {TRADES}, l as (select part % 50 as market, case when supp % 2 = 0 then 'ask' else 'bid' end as side, counter as n, base as d, sum(base)::bigint as amount from tr group by 1, 2, 3, 4), r as (select *, row_number() over (partition by market, side order by case when side = 'ask' then cast(n as decimal(38, 18)) / d else -cast(n as decimal(38, 18)) / d end, n, d) as level from l) select * from r where level <= 20")
def q21(t: Tables) -> DataFrame:
    rows = views.trades(t).select((F.col("part") % 50).alias("market"), F.when(F.col("supp") % 2 == 0, F.lit("ask")).otherwise(F.lit("bid")).alias("side"), F.col("counter").alias("n"), F.col("base").alias("d"), F.col("base").alias("amount"))
    return markets.order_book(rows, keys=["market"], side="side", n="n", d="d", amount="amount")


@query("q21b_book_faults", """with o as (select l_orderkey // 2 as offer_id, l_partkey % 7 as selling, l_suppkey % 7 as buying, cast(round(l_quantity) as bigint) % 10 as amount, l_linenumber % 5 as n from lineitem)
select distinct offer_id, unnest(list_filter([case when amount <= 0 then 'amount' end, case when n <= 0 then 'price' end, case when selling = buying then 'same asset' end], lambda x : x is not null)) as fault from o
union all select offer_id, 'several offers' from o group by 1 having count(*) > 1""")
def q21b(t: Tables) -> DataFrame:
    """Lines as offers, some of them such as no book may hold."""
    rows = t.lineitem.select(F.floor(F.col("l_orderkey") / 2).alias("offer_id"), (F.col("l_partkey") % 7).alias("selling"), (F.col("l_suppkey") % 7).alias("buying"), (F.round("l_quantity").cast("long") % 10).alias("amount"), (F.col("l_linenumber") % 5).alias("n"), F.lit(3).alias("d"))
    return markets.book_faults(rows)


@query("q22_asset_stats", "select c_nationkey as asset, " + ", ".join(f"count(*) filter (where c_mktsegment = '{s}') as holders_{s}, coalesce(sum(cast(round(c_acctbal * 100) as bigint)) filter (where c_mktsegment = '{s}'), 0)::bigint as balance_{s}" for s in ("AUTOMOBILE", "BUILDING", "MACHINERY")) + ", count(*) as holders from customer group by 1")
def q22(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_nationkey").alias("asset"), views.cents("c_acctbal").alias("balance"), "c_mktsegment")
    return markets.asset_stats(rows, keys=["asset"], balance="balance", status="c_mktsegment", statuses=["AUTOMOBILE", "BUILDING", "MACHINERY"])


@query("q23_islands", "with d as (select distinct user_id, (epoch_us(ts) // 1000) // 86400000 as day from events), k as (select *, day - row_number() over (partition by user_id order by day) as g from d) select user_id, min(day) as first, max(day) as last, count(*) as n from k group by user_id, g")
def q23(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.floor(timing.epoch_ms(F.col("ts")) / DAY).alias("day"))
    return archives.islands(rows, value="day", keys=["user_id"])


@query("q24_duplicates", "select l_orderkey, l_partkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def q24(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")


@query("q25_counts_and_checkpoints", "with c as (select o_orderkey, least((o_orderkey + 64) // 64 * 64 - 1, 4294967295) as next, greatest((o_orderkey + 1) // 64 * 64 - 1, 63) as previous, (o_orderkey + 1) % 64 = 0 as is_one from orders) select next, previous, is_one, count(*) as n, min(o_orderkey) as least from c group by 1, 2, 3")
def q25(t: Tables) -> DataFrame:
    s = F.col("o_orderkey")
    return t.orders.groupBy(ids.next_checkpoint(s).alias("next"), ids.previous_checkpoint(s).alias("previous"), ids.is_checkpoint(s).alias("is_one")).agg(F.count("*").alias("n"), F.min(s).alias("least"))


def _topics(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("contract"), F.filter(F.array(F.col("event_type"), k, F.when(F.col("event_id") % 3 == 0, F.lit("x"))), lambda x: x.isNotNull()).alias("topics"))


TOPICS = "tp as (select event_id, event_type as kind, user_id as contract, case when event_id % 3 = 0 then [event_type, json_extract_string(props, '$.k'), 'x'] else [event_type, json_extract_string(props, '$.k')] end as topics from events)"


@query("q26_event_filter", f"with {TOPICS} select event_id, kind, contract from tp where (kind in ('click', 'purchase') and contract in (1, 2, 3, 5, 8, 13) and ((len(topics) = 2 and topics[1] = 'click') or (len(topics) >= 1 and topics[1] = 'purchase'))) or (len(topics) = 3 and topics[3] = 'x' and topics[2] = '7')")
def q26(t: Tables) -> DataFrame:
    filters = [ev.EventFilter(types=("click", "purchase"), contracts=(1, 2, 3, 5, 8), topics=(("click", "*"), ("purchase", "**"))), ev.EventFilter(types=("click", "purchase"), contracts=(13,), topics=(("click", "*"), ("purchase", "**"))), ev.EventFilter(topics=(("*", "7", "x"),))]
    return _topics(t).where(ev.fits(filters, kind=F.col("kind"), contract=F.col("contract"), topics=F.col("topics"))).select("event_id", "kind", "contract")


@query("q27_positional_topics", f"with {TOPICS} select event_id, topics[2] as second from tp where topics[1] = 'view' and topics[3] = 'x'")
def q27(t: Tables) -> DataFrame:
    return _topics(t).where(ev.fits_positions(F.col("topics"), ("view", None, "x", None))).select("event_id", F.get("topics", F.lit(1)).alias("second"))


@query("q28_changed_except", f"with {CHANGES}, p as (select event_id, kind, value, lag(kind) over w as kind0, lag(value) over w as value0 from ch window w as (partition by user_id order by ms, event_id)) select event_id from p where kind is distinct from kind0 or value is distinct from value0")
def q28(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ms", "event_id")
    rows = views.changes(t).select("event_id", "kind", "value", F.lag("kind").over(w).alias("kind0"), F.lag("value").over(w).alias("value0"))
    return rows.where(ch.changed_except(rows, ["kind0", "value0"], ["kind", "value"])).select("event_id")


@query("q29_flags", "select p_partkey, p_size & 4 <> 0 as clawback, p_size & 1 <> 0 as required, p_size & 2 <> 0 as revocable from part")
def q29(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", *[assets.has_flag(F.col("p_size"), bit).alias(name) for name, bit in (("clawback", 4), ("required", 1), ("revocable", 2))])


@query("q30_hash_join", "with e as (select sha256(cast(o_orderkey as varchar)) as hash, o_totalprice > 1000 as large from orders), p as (select sha256(cast(l_orderkey as varchar)) as hash, l_orderkey, l_linenumber from lineitem) select l_orderkey, l_linenumber, large, row_number() over (partition by l_orderkey order by l_linenumber) as apply_index from p join e using (hash)")
def q30(t: Tables) -> DataFrame:
    envelopes = t.orders.select(F.unhex(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("hash"), (F.col("o_totalprice") > 1000).alias("large"))
    processed = t.lineitem.select(F.unhex(F.sha2(F.col("l_orderkey").cast("string"), 256)).alias("hash"), "l_orderkey", "l_linenumber")
    return processed.join(envelopes, "hash").select("l_orderkey", "l_linenumber", "large", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).cast("long").alias("apply_index"))


@query("q31_wanted", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in (select p_partkey from part where p_size = 7)")
def q31(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part.where("p_size = 7").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("q32_outer_of_three", "with h as (select o_orderkey as seq, o_orderstatus from orders where o_orderkey % 3 <> 0), x as (select l_orderkey as seq, count(*) as txs from lineitem where l_orderkey % 5 <> 0 group by 1), r as (select l_orderkey as seq, max(l_linenumber) as results from lineitem where l_orderkey % 7 <> 0 group by 1) select seq, o_orderstatus, txs, results from h full join x using (seq) full join r using (seq)")
def q32(t: Tables) -> DataFrame:
    h = t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("seq"), "o_orderstatus")
    x = t.lineitem.where("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("seq")).agg(F.count("*").alias("txs"))
    r = t.lineitem.where("l_orderkey % 7 <> 0").groupBy(F.col("l_orderkey").alias("seq")).agg(F.max("l_linenumber").alias("results"))
    return h.join(x, "seq", "full").join(r, "seq", "full")


def _missing_files(t: Tables, present: DataFrame) -> DataFrame:
    """What is not there of the grid from the least to the greatest checkpoint that is."""
    low, high = present.agg(F.min("checkpoint"), F.max("checkpoint")).first()
    expected = archives.expected_files(t.spark, first=low or 0, last=-1 if high is None else high, every=64, categories=["ledger", "results", "transactions"])
    return archives.missing(expected, present, keys=["category", "checkpoint"])


@query("q33_missing_files", "with p as (select distinct case o_custkey % 40 when 0 then 'ledger' when 1 then 'results' else 'transactions' end as category, (o_orderkey + 64) // 64 * 64 - 1 as checkpoint from orders), g as (select unnest(range(lo, hi + 1, 64)) as checkpoint from (select min(checkpoint) as lo, max(checkpoint) as hi from p)), c as (select unnest(['ledger', 'results', 'transactions']) as category) select category, checkpoint from c, g where not exists (select 1 from p where p.category = c.category and p.checkpoint = g.checkpoint)")
def q33(t: Tables) -> DataFrame:
    """Orders as files, of a category by customer: the rare ones leave gaps."""
    rest = F.col("o_custkey") % 40
    category = F.when(rest == 0, F.lit("ledger")).when(rest == 1, F.lit("results")).otherwise(F.lit("transactions"))
    return _missing_files(t, t.orders.select(category.alias("category"), ids.next_checkpoint(F.col("o_orderkey")).alias("checkpoint")))


@query("q33b_missing_files_all", "with p as (select distinct case l_linenumber % 3 when 0 then 'ledger' when 1 then 'results' else 'transactions' end as category, (l_orderkey + 64) // 64 * 64 - 1 as checkpoint from lineitem), g as (select unnest(range(lo, hi + 1, 64)) as checkpoint from (select min(checkpoint) as lo, max(checkpoint) as hi from p)), c as (select unnest(['ledger', 'results', 'transactions']) as category) select category, checkpoint from c, g where not exists (select 1 from p where p.category = c.category and p.checkpoint = g.checkpoint)")
def q33b(t: Tables) -> DataFrame:
    """Over all rows, from the table's least to its greatest checkpoint."""
    line = F.col("l_linenumber") % 3
    present = t.lineitem.select(F.when(line == 0, F.lit("ledger")).when(line == 1, F.lit("results")).otherwise(F.lit("transactions")).alias("category"), ids.next_checkpoint(F.col("l_orderkey")).alias("checkpoint"))
    return _missing_files(t, present)


@query("q34_either_key", "select distinct l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size = 3) or l_suppkey in (select s_suppkey from supplier where s_nationkey = 3)")
def q34(t: Tables) -> DataFrame:
    cols = ["l_orderkey", "l_linenumber"]
    a = t.lineitem.join(t.part.where("p_size = 3").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select(*cols)
    b = t.lineitem.join(t.supplier.where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").select(*cols)
    return a.union(b).distinct()


@query("q35_as_of", "with h as (select (epoch_us(o_orderdate) // 1000) // 1000 as ts, min(o_orderkey) as ledger from orders group by 1), w as (select distinct (epoch_us(l_shipdate) // 1000) // 1000 + 1 as wanted from lineitem), m as (select wanted, min(ts) as t from w join h on ts >= wanted group by 1) select wanted, coalesce(h.ledger, (select arg_max(ledger, ts) from h)) as ledger from w left join m using (wanted) left join h on h.ts = m.t")
def q35(t: Tables) -> DataFrame:
    sec = lambda c: F.floor(timing.epoch_ms(F.col(c)) / 1000).cast("long")
    h = t.orders.groupBy(sec("o_orderdate").alias("ts")).agg(F.min("o_orderkey").alias("ledger"))
    w = t.lineitem.select((sec("l_shipdate") + 1).alias("wanted")).distinct()
    return archives.as_of_forward(h, time="ts", value="ledger", wanted=w, at="wanted")


@query("q36_expiring", "with k as (select sha256(cast(c_custkey as varchar)) as hash, c_custkey, cast(round(c_acctbal * 100) as bigint) as balance from customer), x as (select sha256(cast(o_custkey as varchar)) as hash, max((epoch_us(o_orderdate) // 1000)) as live_until from orders group by 1) select c_custkey, balance, live_until from k join x using (hash) where live_until <= 800000000000")
def q36(t: Tables) -> DataFrame:
    k = t.customer.select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("hash"), "c_custkey", views.cents("c_acctbal").alias("balance"))
    x = t.orders.groupBy(F.sha2(F.col("o_custkey").cast("string"), 256).alias("hash")).agg(F.max(timing.epoch_ms(F.col("o_orderdate"))).alias("live_until"))
    return k.join(x, "hash").where("live_until <= 800000000000").select("c_custkey", "balance", "live_until")


@query("q37_dimension", "select n_name, r_name, count(*) as customers, sum(cast(round(c_acctbal * 100) as bigint))::bigint as balance from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1, 2")
def q37(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.sum(views.cents("c_acctbal")).alias("balance"))


@query("q38_hash_chain", "with h as (select event_id as sequence, user_id as hash, case when event_id % 50 = 0 then -1 else lag(user_id) over (order by event_id) end as prev_hash from events where event_id % 200 <> 17), l as (select *, lag(sequence) over (order by sequence) as s0, lag(hash) over (order by sequence) as h0, min(sequence) over () as least from h) select sequence, hash, prev_hash, case when s0 is distinct from sequence - 1 then 'gap' else 'hash' end as why from l where sequence > least and (s0 is distinct from sequence - 1 or prev_hash is distinct from h0)")
def q38(t: Tables) -> DataFrame:
    e = t.events.where("event_id % 200 <> 17").select(F.col("event_id").alias("sequence"), F.col("user_id").alias("hash"))
    before = e.select((F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("p1")).unionByName(e.where("sequence % 200 = 16").select((F.col("sequence") + 2).alias("sequence"), F.col("hash").alias("p1")))
    h = e.join(before, "sequence", "left").select("sequence", "hash", F.when(F.col("sequence") % 50 == 0, F.lit(-1)).otherwise(F.col("p1")).alias("prev_hash"))
    return archives.chain_breaks(h)


@query("q39_top_per_group", f"with {TRADES}, r as (select part, ledger, line, counter, row_number() over (partition by part order by counter, ledger, line) as k from tr) select part, ledger, line, counter, k from r where k <= 3")
def q39(t: Tables) -> DataFrame:
    return snapshot.newest_ranked(views.trades(t).select("part", "ledger", "line", "counter"), keys=["part"], newest_first=[F.col("counter"), F.col("ledger"), F.col("line")]).withColumnRenamed("age", "k").where("k <= 3")


@query("q40_phase_bounds", "with s as (select l_orderkey, l_linenumber as phase, cast(l_quantity as bigint) as size from lineitem) select l_orderkey, phase, coalesce(sum(size) over (partition by l_orderkey order by phase, size rows between unbounded preceding and 1 preceding), 0)::bigint as first, sum(size) over (partition by l_orderkey order by phase, size rows between unbounded preceding and current row)::bigint as ending from s")
def q40(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("phase", "size")
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("phase"), F.col("l_quantity").cast("long").alias("size"))
    total = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("l_orderkey", "phase", (total - F.col("size")).alias("first"), total.alias("ending"))


@query("q41_fractions", f"""with {TRADES}, a as (select ledger, line, counter * 100000 as amount, part as n, base as d, supp * 1000 as needed from tr where base > 0 and part > 0),
b as (select *, (amount::hugeint * n) // d as down, (amount::hugeint * n + d - 1) // d as up from a),
c as (select *, case when n > d then amount else (down * d + n - 1) // n end as bound from b), e as (select *, least(bound, needed) as bought from c)
select ledger, line, down::bigint as down, up::bigint as up, bought::bigint as bought, ((bought * n + d - 1) // d)::bigint as sold from e""")
def q41(t: Tables) -> DataFrame:
    c = F.col
    rows = views.trades(t).where("base > 0 and part > 0").select("ledger", "line", (c("counter") * 100000).alias("amount"), c("part").alias("n"), c("base").alias("d"), (c("supp") * 1000).alias("needed"))
    rows = money.with_buying_units(rows)
    return rows.select("ledger", "line", money.mul_floor(c("amount"), c("n"), c("d")).alias("down"), money.mul_ceil(c("amount"), c("n"), c("d")).alias("up"), "bought", "sold")


@query("q42_prices", f"with {TRADES} select ledger, line, counter * 3 < 700000 * base as cheaper, counter * 2 = 2 * counter as same, counter // gcd(counter, base) as n, base // gcd(counter, base) as d from tr where base > 0")
def q42(t: Tables) -> DataFrame:
    c = F.col
    rows = views.trades(t).where("base > 0").withColumn("g", money.gcd(c("counter"), c("base")))
    return rows.select("ledger", "line", money.price_cheaper(c("counter"), c("base"), F.lit(700000), F.lit(3)).alias("cheaper"), money.price_equal(c("counter"), F.lit(2), c("counter"), F.lit(2)).alias("same"), F.expr("counter div g").alias("n"), F.expr("base div g").alias("d"))


@query("q43_amounts", f"with {TRADES} select ledger, line, cast(cast(counter as decimal(38, 7)) / 10000000 as decimal(20, 7))::varchar as text, counter as units, (counter // 10000000)::varchar || '.' || printf('%07d', counter % 10000000) as long_text from tr")
def q43(t: Tables) -> DataFrame:
    c = F.col
    rows = views.trades(t).select("ledger", "line", money.amount_text(c("counter")).alias("text"), money.long_amount_text(c("counter").cast("string")).alias("long_text"))
    return rows.withColumn("units", money.parse_amount(c("text")))


@query("q44_pools", f"""with {TRADES}, p as (select ledger, line, counter * 1000 as x, base * 1000000 as y, part * 100 as r, 30 as fee from tr)
select ledger, line, case when r > 0 and x > 0 and y > 0 and ((10000 - fee)::hugeint * r * y) // (x::hugeint * 10000 + (10000 - fee)::hugeint * r) > 0 then (((10000 - fee)::hugeint * r * y) // (x::hugeint * 10000 + (10000 - fee)::hugeint * r))::bigint end as payout,
  case when r > 0 and x > 0 and r < y then ((x::hugeint * 10000 * r + (y - r)::hugeint * (10000 - fee) - 1) // ((y - r)::hugeint * (10000 - fee)))::bigint end as expectation from p""")
def q44(t: Tables) -> DataFrame:
    c = F.col
    rows = views.trades(t).select("ledger", "line", (c("counter") * 1000).alias("x"), (c("base") * 1000000).alias("y"), (c("part") * 100).alias("r"))
    return rows.select("ledger", "line", money.pool_payout(c("x"), c("y"), c("r"), F.lit(30)).alias("payout"), money.pool_expectation(c("x"), c("y"), c("r"), F.lit(30)).alias("expectation"))


@query("q45_archive_paths", "select distinct 'ledger/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || substr(h, 5, 2) || '/ledger-' || h || '.xdr.gz' as path, chk as checkpoint from (select printf('%08x', (o_orderkey + 64) // 64 * 64 - 1) as h, (o_orderkey + 64) // 64 * 64 - 1 as chk from orders)")
def q45(t: Tables) -> DataFrame:
    chk = t.orders.select(ids.next_checkpoint(F.col("o_orderkey")).alias("checkpoint")).distinct()
    files = chk.select(ids.category_path(F.lit("ledger"), F.col("checkpoint")).alias("path"))
    return files.join(lake.archive_files(files).select(ids.category_path(F.col("category"), F.col("checkpoint")).alias("path"), "checkpoint"), "path")


@query("q46_asset_names", "select p_partkey, split_part(p_brand, '#', 2) || ':' || p_type as canonical, 'credit/' || p_brand || '/' || p_type as display, upper(replace(p_type, '-', '_')) as constant, 2 as listed, 'native' as first_code from part")
def q46(t: Tables) -> DataFrame:
    c = F.col
    rows = t.part.withColumn("code", F.split("p_brand", "#")[1])
    listed = assets.parse_list(F.concat(F.lit("Native, "), F.lit("USD"), F.lit(":issuer")))
    return rows.select("p_partkey", assets.canonical(c("code"), c("p_type")).alias("canonical"), assets.display(F.lit("credit"), c("p_brand"), c("p_type")).alias("display"), assets.constant_case(c("p_type")).alias("constant"), F.size(listed).alias("listed"), listed[0]["code"].alias("first_code"))


@query("q47_json", "select event_id, json_extract_string(props, '$.k')::bigint as k, json_extract_string(props, '$.k')::bigint % 2 = 0 as even from events")
def q47(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k")).withColumn("even", F.col("k") % 2 == 0)


_offers = views.offers


FILL_SQL = """with recursive o as (select 'a' || (l_partkey % 40) as selling, 'a' || (l_suppkey % 40) as buying, cast(l_quantity as bigint) as amount, cast(1 + l_linenumber as bigint) as n, 1 + l_orderkey % 5 as d, l_orderkey * 10 + l_linenumber as offer_id from lineitem where l_partkey % 40 <> l_suppkey % 40),
k as (select *, row_number() over (partition by selling, buying order by cast(n as decimal(38, 18)) / d, offer_id, amount) as i from o),
f(selling, buying, i, owed, paid) as (select selling, buying, i, 40 - least(40, amount), (least(40, amount) * n + d - 1) // d from k where i = 1
  union all select k.selling, k.buying, k.i, f.owed - least(f.owed, k.amount), f.paid + (least(f.owed, k.amount) * k.n + k.d - 1) // k.d from f join k on k.selling = f.selling and k.buying = f.buying and k.i = f.i + 1)
select selling, buying, max(case when owed = 0 then paid end)::bigint as cost from (select *, row_number() over (partition by selling, buying order by i desc) as r from f) where r = 1 group by selling, buying"""


@query("q48_greedy_fill", FILL_SQL)
def q48(t: Tables) -> DataFrame:
    """What 40 units cost in each pair, offer by offer in SQL, by running sums here; null where a pair has fewer."""
    pairs = _offers(t).select("selling", "buying").distinct()
    cost = paths.bought(pairs.select(F.col("selling").alias("asset"), F.lit(40).cast("long").alias("amount")).distinct(), scratch.written(paths.levels(_offers(t)), "levels"))
    return pairs.join(cost.select(F.col("asset").alias("selling"), F.col("there").alias("buying"), F.col("next").alias("cost")), ["selling", "buying"], "left")


@query("q48b_greedy_fill_all", f"with {LEVELS}, p as (select distinct selling, buying from o) select p.selling, p.buying, cb + ((40 - ab) * n + d - 1) // d as cost from p left join lv on lv.selling = p.selling and lv.buying = p.buying and 40 > ab and 40 <= ab + amount")
def q48b(t: Tables) -> DataFrame:
    """What 40 units cost in each pair, over all offers; null where a pair has fewer."""
    level = scratch.written(paths.levels(_offers(t)), "levels")
    pairs = level.select("selling", "buying").distinct()
    cost = paths.bought(pairs.select(F.col("selling").alias("asset"), F.lit(40).cast("long").alias("amount")).distinct(), level)
    return pairs.join(cost.select(F.col("asset").alias("selling"), F.col("there").alias("buying"), F.col("next").alias("cost")), ["selling", "buying"], "left")


@query("q50_tumbling", "select event_type, (epoch_us(ts) // 1000) // 86400000 * 86400000 as start, count(*) as n from events group by 1, 2")
def q50(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", timing.round_down(timing.epoch_ms(F.col("ts")), DAY).alias("start")).agg(F.count("*").alias("n"))


@query("q51_sliding", "with e as (select event_type, (epoch_us(ts) // 1000) as ms, unnest(range(4)) as k from events) select event_type, ms // 21600000 * 21600000 - k * 21600000 as start, count(*) as n from e group by 1, 2")
def q51(t: Tables) -> DataFrame:
    w = F.window("ts", "1 day", "6 hours")
    return t.events.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n")).select("event_type", timing.epoch_ms(F.col("w.start").cast("timestamp_ntz")).alias("start"), "n")


@query("q52_sessions", "with e as (select user_id, (epoch_us(ts) // 1000) as ms from events), g as (select *, case when ms - lag(ms) over (partition by user_id order by ms) < 21600000 then 0 else 1 end as new from e), s as (select *, sum(new) over (partition by user_id order by ms rows between unbounded preceding and current row) as k from g) select user_id, min(ms) as start, max(ms) as last, count(*) as n from s group by user_id, k")
def q52(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", timing.epoch_ms(F.col("ts")).alias("ms"))
    return rows.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("ms").alias("start"), F.max("ms").alias("last"), F.count("*").alias("n")).select("user_id", "start", "last", "n")


@query("q53_late", "with e as (select event_id, user_id, (epoch_us(ts) // 1000) as ms, max((epoch_us(ts) // 1000)) over (partition by user_id order by value, event_id rows between unbounded preceding and 1 preceding) as seen from events) select event_id, user_id, seen - ms as late_by from e where ms < seen - 3600000")
def q53(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("value", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = t.events.select("event_id", "user_id", "value", timing.epoch_ms(F.col("ts")).alias("ms")).withColumn("seen", F.max("ms").over(w))
    return rows.where("ms < seen - 3600000").select("event_id", "user_id", (F.col("seen") - F.col("ms")).alias("late_by"))


@query("q54_trade_routes", "select o_orderpriority, count(*) as n from orders group by 1")
def q54(t: Tables) -> DataFrame:
    lines = t.orders.select(F.concat(F.lit('- - - - - - - - - 200 "GET https://h/'), F.replace("o_orderpriority", F.lit(" "), F.lit("_")), F.lit(' HTTP/1.1"')).alias("value"))
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    route = lake.route_of(F.col("uri"), [(f"/{n.replace(' ', '_')}$", n) for n in names])
    uris = lake.requests(lines).select(route.alias("o_orderpriority"))
    return uris.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("q54b_stream_windows", "select event_type, epoch_us(ts) // 1000 // 86400000 * 86400000 as start, count(*) as n from events group by 1, 2")
def q54b(t: Tables) -> DataFrame:
    """The tumbling windows of q50, from a stream that runs until it has read all there is."""
    stream = ledger_stream.file_stream(t.spark, f"{t.folder}/events.parquet")
    counts = ledger_stream.windowed_counts(stream, time="ts", keys=["event_type"], length="1 day")
    sink = scratch.shared_path(t.spark, "stream")
    ledger_stream.run_into(counts, ledger_stream.replaced_table(sink), mode="complete", checkpoint=scratch.shared_path(t.spark, "offsets"))
    return ledger_stream.last_version(t.spark, sink).select("event_type", F.unix_millis("window.start").alias("start"), "n")


def _streamed_changes(t: Tables, shape=None) -> DataFrame:
    """Changes of users as they come out of a stream into an ordered table, a ledger being a day."""
    events = ledger_stream.file_stream(t.spark, f"{t.folder}/events.parquet")
    rows = views.changes(SimpleNamespace(events=events)).withColumn("ledger", F.unix_date("day"))
    sink = scratch.shared_path(t.spark, "stream")
    ledger_stream.run_into(rows, ledger_stream.ordered_table(sink, sequence="ledger", shape=shape), mode="append", checkpoint=scratch.shared_path(t.spark, "offsets"))
    return ledger_stream.ordered_rows(t.spark, sink)


@query("q54c_stream_book", f"with {CHANGES}, r as (select *, row_number() over (partition by user_id order by ms desc, event_id desc) as k from ch) select user_id, event_id, value from r where k = 1 and kind <> 'removed'")
def q54c(t: Tables) -> DataFrame:
    """What is live after all ledgers of a stream, as an order book is kept: the newest change of each key that is no removal."""
    live = snapshot.newest(_streamed_changes(t), keys=["user_id"], newest_first=[-F.col("ledger"), -F.col("ms"), -F.col("event_id")], dead=F.col("kind") == "removed")
    return live.select("user_id", "event_id", "value")


@query("q54d_stream_compaction", COMPACT_SQL)
def q54d(t: Tables) -> DataFrame:
    """The compaction of q12, ledger by ledger, of a stream."""
    value = F.col("value")

    def compact(df: DataFrame) -> DataFrame:
        sides = df.withColumns({"pre": F.when(F.col("kind") != "created", value), "post": F.when(F.col("kind") != "removed", value)})
        return ch.compacted(sides, keys=["user_id", "day"], order=["ms", "event_id"], on_error="mark")

    return _streamed_changes(t, compact).drop("batch")


@query("q55_trade_legs", f"with {TRADES}, x as (select ledger, line, 's' || supp as seller, 'l' || ledger as taker, 'p' || part as sold, base, counter from tr) select ledger, line, 0 as leg, seller as source, taker as target, sold as asset, base as amount from x union all select ledger, line, 1, taker, seller, 'cents', counter from x")
def q55(t: Tables) -> DataFrame:
    c = F.col
    atoms = views.trades(t).select("ledger", "line", F.concat(F.lit("s"), c("supp")).alias("seller"), F.concat(F.lit("l"), c("ledger")).alias("taker"), F.concat(F.lit("p"), c("part")).alias("sold"), F.lit("cents").alias("bought"), "base", "counter")
    return transfers.trade_legs(atoms, keep=["ledger", "line"], seller="seller", taker="taker", sold="sold", sold_amount="base", bought="bought", bought_amount="counter")


@query("q56_movement_kinds", f"with {TRADES} select ledger, line, case when supp % 7 = part % 7 and not (ledger % 7 = part % 7) then 'mint' when ledger % 7 = part % 7 and not (supp % 7 = part % 7) then 'burn' else 'transfer' end as kind from tr")
def q56(t: Tables) -> DataFrame:
    c = F.col
    return views.trades(t).select("ledger", "line", transfers.movement_kind(asset_issuer=c("part") % 7, source=c("supp") % 7, target=c("ledger") % 7).alias("kind"))


@query("q57_event_order", "with e as (select l_orderkey as ledger, l_partkey as tx, l_linenumber as line, case l_linenumber % 3 when 0 then 'fee' when 1 then 'op' else 'refund' end as step, case when l_orderkey % 2 = 0 then 23 else 22 end as protocol from lineitem) select ledger, line, row_number() over (partition by ledger order by case when protocol >= 23 then case step when 'refund' then 2 when 'fee' then 0 else 1 end else case step when 'fee' then 0 else 1 end end, tx, case step when 'refund' then 1 else 0 end, line) as place from e")
def q57(t: Tables) -> DataFrame:
    line = F.col("l_linenumber") % 3
    rows = t.lineitem.select(F.col("l_orderkey").alias("ledger"), F.col("l_partkey").alias("tx_index"), F.col("l_linenumber").alias("line"), F.when(line == 0, F.lit("fee")).when(line == 1, F.lit("op")).otherwise(F.lit("refund")).alias("step"), F.when(F.col("l_orderkey") % 2 == 0, 23).otherwise(22).alias("protocol"))
    return transfers.event_order(rows, order=["line"]).select("ledger", "line", "place")


@query("q58_upsert", "with o as (select c_custkey, c_name, cast(round(c_acctbal * 100) as bigint) as balance from customer where c_custkey % 5 <> 0), n as (select c_custkey, upper(c_name) as c_name, 0::bigint as balance from customer where c_custkey % 3 = 0), u as (select * from o where c_custkey not in (select c_custkey from n) union all select * from n) select * from u where not (c_custkey >= 10 and c_custkey < 40)")
def q58(t: Tables) -> DataFrame:
    old = t.customer.where("c_custkey % 5 <> 0").select("c_custkey", "c_name", views.cents("c_acctbal").alias("balance"))
    new = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(0).cast("long").alias("balance"))
    return tables.without_range(tables.upserted(old, new, keys=["c_custkey"]), column="c_custkey", start=10, end=40)


@query("q59_set_operations", "with a as (select distinct l_partkey as k from lineitem where l_linenumber = 1), b as (select distinct l_partkey as k from lineitem where l_linenumber = 2) select 'union' as op, k from (select k from a union select k from b) union all select 'intersect', k from (select k from a intersect select k from b) union all select 'except', k from (select k from a except select k from b)")
def q59(t: Tables) -> DataFrame:
    a, b = (t.lineitem.where(F.col("l_linenumber") == n).select(F.col("l_partkey").alias("k")).distinct() for n in (1, 2))
    named = lambda op, df: df.select(F.lit(op).alias("op"), "k")
    return named("union", a.union(b).distinct()).union(named("intersect", a.intersect(b))).union(named("except", a.exceptAll(b)))


@query("q60_cube", "select l_returnflag, l_linestatus, count(*) as n, sum(cast(l_quantity as bigint))::bigint as quantity from lineitem group by cube (l_returnflag, l_linestatus)")
def q60(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("q61_rollup", "select r_name, n_name, count(*) as n from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by rollup (r_name, n_name)")
def q61(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("q62_distinct_counts", "select o_orderpriority, count(distinct o_custkey) as customers, count(distinct cast(o_orderdate as date)) as days from orders group by 1")
def q62(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.to_date("o_orderdate")).alias("days"))


@query("q63_approx_distinct")
def q63(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"))


@query("q64_ranks", "select c_custkey, ntile(4) over (partition by c_nationkey order by c_acctbal, c_custkey) as quarter, dense_rank() over (partition by c_nationkey order by c_mktsegment) as segment from customer")
def q64(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_nationkey")
    return t.customer.select("c_custkey", F.ntile(4).over(w.orderBy("c_acctbal", "c_custkey")).cast("long").alias("quarter"), F.dense_rank().over(w.orderBy("c_mktsegment")).cast("long").alias("segment"))


@query("q65_range_frame", "with e as (select event_id, user_id, (epoch_us(ts) // 1000) as ms from events) select event_id, count(*) over (partition by user_id order by ms range between 86400000 preceding and current row) as within_day from e")
def q65(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ms").rangeBetween(-DAY, 0)
    return t.events.select("event_id", "user_id", timing.epoch_ms(F.col("ts")).alias("ms")).select("event_id", F.count("*").over(w).alias("within_day"))


@query("q66_grouping_sets", "select l_shipmode_like, l_returnflag, count(*) as n from (select case when l_quantity > 25 then 'bulk' else 'small' end as l_shipmode_like, l_returnflag from lineitem) group by grouping sets ((l_shipmode_like), (l_returnflag), ())")
def q66(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.when(F.col("l_quantity") > 25, F.lit("bulk")).otherwise(F.lit("small")).alias("l_shipmode_like"), "l_returnflag")
    a, b = F.col("l_shipmode_like"), F.col("l_returnflag")
    return rows.groupingSets([[a], [b], []], a, b).agg(F.count("*").alias("n"))


@query("q67_batches", "select o_orderkey // 64 * 64 as start, min(o_orderkey) as first, max(o_orderkey) as last, count(*) as n from orders group by 1")
def q67(t: Tables) -> DataFrame:
    dense = t.orders.select("o_orderkey")
    return dense.groupBy(ids.file_start(F.col("o_orderkey"), 64).alias("start")).agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.count("*").alias("n"))


@query("q68_operation_movements", f"""with {TRADES}, o as (select ledger, part as tx_index, line as op_index, base % 5 <> 0 as ok, case line % 4 when 0 then 'payment' when 1 then 'create_account' when 2 then 'create_claimable_balance' else 'clawback' end as type,
 'h' || (supp % 9) as src, 'h' || (part % 9) as dst, 'b' || ledger as bal, 'A' || (part % 4) as asset, 'h' || (part % 4) as issuer, counter as amount from tr),
m as (select *, case type when 'clawback' then dst else src end as source, case type when 'create_claimable_balance' then bal when 'clawback' then null else dst end as target from o where ok)
select ledger, tx_index, op_index, case when type = 'clawback' then 'clawback' when type = 'create_account' then 'transfer' when source = issuer and target is distinct from issuer then 'mint' when target = issuer and source is distinct from issuer then 'burn' else 'transfer' end as kind,
 source, target, case when type = 'create_account' then 'native' else asset end as asset, amount from m""")
def q68(t: Tables) -> DataFrame:
    c = F.col
    kind = F.when(c("line") % 4 == 0, F.lit("payment")).when(c("line") % 4 == 1, F.lit("create_account")).when(c("line") % 4 == 2, F.lit("create_claimable_balance")).otherwise(F.lit("clawback"))
    holder = lambda x: F.concat(F.lit("h"), x)
    ops = views.trades(t).select("ledger", c("part").alias("tx_index"), c("line").alias("op_index"), (c("base") % 5 != 0).alias("tx_successful"), kind.alias("type"), holder(c("supp") % 9).alias("op_source"), holder(c("part") % 9).alias("destination"), F.concat(F.lit("b"), c("ledger")).alias("balance_id"), F.concat(F.lit("A"), c("part") % 4).alias("asset"), holder(c("part") % 4).alias("issuer"), c("counter").alias("amount"))
    return transfers.operation_movements(ops)


@query("q69_state_deltas", f"with {CHANGES}, p as (select user_id, day, lag(value) over (partition by user_id order by ms, event_id) as pre, case when kind = 'removed' then null else value end as post from ch) select user_id, day, sum(coalesce(post, 0) - coalesce(pre, 0))::bigint as delta from p group by 1, 2 having sum(coalesce(post, 0) - coalesce(pre, 0)) <> 0")
def q69(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ms", "event_id")
    rows = views.changes(t).select("user_id", "day", F.lag("value").over(w).alias("pre"), F.when(F.col("kind") != "removed", F.col("value")).alias("post"))
    return _longs(deltas.state_deltas(rows, keys=["user_id", "day"]))


@query("q70_compare_hashes", "with e as (select o_orderkey as k, sha256(cast(o_custkey as varchar)) as h from orders), a as (select o_orderkey as k, sha256(cast(case when o_orderkey % 11 = 0 then -1 else o_custkey end as varchar)) as h from orders where o_orderkey % 13 <> 0) select k, e.h as expected, a.h as actual from e left join a using (k) where e.h is distinct from a.h and not (a.h is null and k % 26 = 0)")
def q70(t: Tables) -> DataFrame:
    h = lambda c: F.sha2(c.cast("string"), 256).alias("h")
    k = F.col("o_orderkey")
    e = t.orders.select(k.alias("k"), h(F.col("o_custkey")))
    a = t.orders.where("o_orderkey % 13 <> 0").select(k.alias("k"), h(F.when(k % 11 == 0, F.lit(-1)).otherwise(F.col("o_custkey"))))
    return archives.compare(e, a, keys=["k"], value="h", exempt=F.col("k") % 26 == 0)


def _nested(t: Tables) -> DataFrame:
    """Orders as ledgers, their lines as transactions of one operation."""
    hashed = F.sha2(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), 256)
    line = t.lineitem.select("l_orderkey", "l_linenumber", hashed.alias("hash"), F.concat(F.lit("s"), "l_suppkey").alias("source"), views.cents("l_extendedprice").alias("amount"), "l_returnflag").dropDuplicates(["hash"])
    op = F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.lit("own")).alias("source"), F.col("amount"))
    asked = F.struct("hash", "source", F.array(op).alias("operations"))
    done = F.struct("l_linenumber", "hash", F.when(F.col("l_returnflag") == "R", F.lit("failed")).otherwise(F.lit("success")).alias("result_code"))
    return line.groupBy(F.col("l_orderkey").alias("sequence")).agg(F.lit(23).alias("protocol"), F.array_sort(F.collect_list(asked)).alias("envelopes"), F.array_sort(F.collect_list(done)).alias("processing"))


@query("q71_flatten_operations", """with h as (select distinct l_orderkey as ledger, l_linenumber, sha256(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity) as hash, 's' || l_suppkey as source, cast(round(l_extendedprice * 100) as bigint) as amount, l_returnflag from lineitem),
i as (select *, row_number() over (partition by ledger order by l_linenumber, hash) as tx_index from h)
select ledger, tx_index, 1::bigint as op_index, ledger * 4294967296 + tx_index * 4096 + 1 as position, l_returnflag <> 'R' as tx_successful, case when l_linenumber % 2 = 0 then 'own' else source end as op_source, amount from i""")
def q71(t: Tables) -> DataFrame:
    ops = flatten.operations(flatten.transactions(_nested(t)))
    return ops.select("ledger", "tx_index", "op_index", "position", "tx_successful", "op_source", F.col("op.amount").alias("amount"))


@query("q72_paired_changes", f"""with {CHANGES}, o as (select user_id, kind, value, row_number() over (partition by user_id order by ms, event_id) - 1 as k from ch),
p as (select *, lag(kind) over w as kind0, lag(value) over w as value0 from o window w as (partition by user_id order by k))
select user_id, row_number() over (partition by user_id order by k) - 1 as ord, kind as type, case when kind0 = 'created' and kind <> 'created' then value0 end as pre, case when kind <> 'removed' then value end as post from p where kind <> 'created'""")
def q72(t: Tables) -> DataFrame:
    """Signups stand for states: what follows one has its value as its pre. A row looks at the row before it, and no user's rows are gathered."""
    return ch.state_pairs(views.changes(t), keys=["user_id"], order=["ms", "event_id"], kind="kind", value="value", state="created").select("user_id", F.col("place").alias("ord"), F.col("kind").alias("type"), "pre", "post")


@query("q73_latest_files", "select max(o_orderkey // 64 * 64 + 63) as latest, min(o_orderkey // 64 * 64) as oldest, max(case when o_orderkey // 64 * 64 <= 3000 then o_orderkey // 64 * 64 + 63 end) as up_to from orders")
def q73(t: Tables) -> DataFrame:
    files = lake.ledger_files(_keys(t).select(F.col("key").alias("path")).distinct())
    return files.agg(F.max("last").alias("latest"), F.min("first").alias("oldest"), F.max(F.when(F.col("first") <= 3000, F.col("last"))).alias("up_to"))
