"""Queries of what is derived from nested ledgers, transactions, changes and entries, of JSON forms and of small codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.functions import address, assets, ids, json_forms as jf, money, timing
from tallyloom.operators import archives, changes as ch, deltas, flatten, paging, projections as pr, snapshot
from tallyloom.plans import views
from tallyloom.plans.registry import Tables, query
from tallyloom.plans.views import CHANGES
from tallyloom.sinks import tables
from tallyloom.sources import lake

c = F.col


def _null(kind: str):
    return F.lit(None).cast(kind)


# ---- ledgers


def _ledgers(t: Tables) -> DataFrame:
    k = c("o_orderkey")
    keys = F.when(k % 5 == 0, F.array(F.concat(F.lit("k"), k), F.concat(F.lit("m"), k)))
    v1 = F.when(k % 3 == 1, F.struct(F.when(k % 2 == 0, F.struct((k % 100).alias("fee_write_1kb"))).alias("ext"), (k * 7).alias("live_bytes"), keys.alias("evicted")))
    v2 = F.when(k % 3 == 2, F.struct((k * 9).alias("live_bytes"), keys.alias("evicted")))
    signed = F.when(k % 4 > 0, F.struct(F.concat(F.lit("n"), k % 4).alias("node_id"), F.md5(k.cast("string")).alias("signature")))
    return t.orders.select(k.alias("sequence"), v1.alias("v1"), v2.alias("v2"), F.struct(signed.alias("signed")).alias("close"))


@query("q81_ledger_fields", "select o_orderkey as sequence, case when o_orderkey % 3 = 1 and o_orderkey % 2 = 0 then o_orderkey % 100 end as fee_write_1kb, case o_orderkey % 3 when 1 then o_orderkey * 7 when 2 then o_orderkey * 9 end as live_bytes, case when o_orderkey % 4 > 0 then 'n' || (o_orderkey % 4) end as node_id, case when o_orderkey % 4 > 0 then md5(o_orderkey::varchar) end as signature from orders")
def q81(t: Tables) -> DataFrame:
    return pr.ledger_fields(_ledgers(t))


@query("q81b_evicted_keys", "select o_orderkey as sequence, unnest(['k' || o_orderkey, 'm' || o_orderkey]) as key from orders where o_orderkey % 5 = 0 and o_orderkey % 3 > 0")
def q81b(t: Tables) -> DataFrame:
    return pr.evicted_keys(_ledgers(t))


@query("q81c_close_times", "select o_orderkey, case when o_orderkey % 2 = 0 then epoch_us(o_orderdate) // 1000 + 7 else epoch_us(o_orderdate) // 1000000 * 1000 end as ms from orders")
def q81c(t: Tables) -> DataFrame:
    ms = views.epoch_ms(c("o_orderdate"))
    return t.orders.select("o_orderkey", flatten.close_ms(F.floor(ms / 1000), F.when(c("o_orderkey") % 2 == 0, ms + 7)).alias("ms"))


@query("q81d_batches_to_ledgers", "select o_orderkey as sequence, o_custkey as payload from orders")
def q81d(t: Tables) -> DataFrame:
    """Ledgers packed into files of 64 and taken out again."""
    packed = t.orders.select(ids.file_start(c("o_orderkey"), 64).alias("start"), F.struct(c("o_orderkey").alias("sequence"), c("o_custkey").alias("payload")).alias("l")).groupBy("start").agg(F.collect_list("l").alias("ledgers"))
    return flatten.ledgers(packed.withColumn("end", c("start") + 63))


@query("q81e_packed_files", "select o_orderkey // 64 * 64 as start, min(o_orderkey) as first, max(o_orderkey) as last, count(*) as n from orders group by 1")
def q81e(t: Tables) -> DataFrame:
    """Files of contiguous ledgers; a gap would be an error."""
    out = tables.packed_batches(t.orders, sequence="o_orderkey", per_file=64)
    return out.select("start", F.element_at("sequences", 1).alias("first"), F.element_at("sequences", -1).alias("last"), F.size("sequences").cast("long").alias("n"))


@query("q81f_object_metadata", "select o_orderkey, case when o_orderkey % 3 > 0 then o_orderkey end as start_ledger, o_orderkey + 63 as end_ledger, -o_custkey as end_ledger_close_time, 'zstd' as compression_type from orders")
def q81f(t: Tables) -> DataFrame:
    """What object metadata, a map of texts, says of a file of ledgers."""
    k = c("o_orderkey")
    start = F.when(k % 3 > 0, F.create_map(F.lit("start-ledger"), k.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    rest = F.create_map(F.lit("end-ledger"), (k + 63).cast("string"), F.lit("end-ledger-close-time"), (-c("o_custkey")).cast("string"), F.lit("compression-type"), F.lit("zstd"))
    return t.orders.select(k, lake.object_metadata(F.map_concat(start, rest)).alias("m")).select("o_orderkey", "m.start_ledger", "m.end_ledger", "m.end_ledger_close_time", "m.compression_type")


@query("q81g_envelopes", "with l as (select o_orderkey as k from orders) select k as sequence, 0 as place, 'v' || k as hash from l where k % 3 = 0 union all select k, i, 'p' || k || '-' || i from l, range(3) r(i) where k % 3 = 1 union all select k, i, 's' || k || '-' || i from l, range(5) r(i) where k % 3 = 2 union all select k, 5, 'c' || k from l where k % 3 = 2")
def q81g(t: Tables) -> DataFrame:
    """Sets of all forms flattened: old ones; a phase of two components; parallel stages of clusters, then a phase of one component."""
    k = c("o_orderkey")
    one = lambda prefix, i=None: F.struct(F.concat(F.lit(prefix), k.cast("string"), F.lit("" if i is None else f"-{i}")).alias("hash"))
    component = lambda *txs: F.struct(F.array(*txs).alias("txs"))
    components, stages = "array<struct<txs:array<struct<hash:string>>>>", "array<array<array<struct<hash:string>>>>"
    phase = lambda x, y: F.struct((_null(components) if x is None else x).alias("components"), (_null(stages) if y is None else y).alias("stages"))
    parts = F.array(phase(F.array(component(one("p", 0)), component(one("p", 1), one("p", 2))), None))
    parallel = F.array(F.array(F.array(one("s", 0), one("s", 1)), F.array(one("s", 2))), F.array(F.array(one("s", 3), one("s", 4))))
    both = F.array(phase(None, parallel), phase(F.array(component(one("c"))), None))
    tx_set = F.struct(F.when(k % 3 == 0, F.array(one("v"))).alias("txs"), F.when(k % 3 == 1, parts).when(k % 3 == 2, both).alias("phases"))
    rows = t.orders.select(k.alias("sequence"), flatten.envelopes(tx_set).alias("e"))
    return rows.select("sequence", F.posexplode("e").alias("place", "e")).select("sequence", "place", "e.hash")


# ---- transactions


def _contract_txs(t: Tables) -> DataFrame:
    k = c("o_orderkey")
    data = F.struct((k % 1000).alias("resource_fee"), (k * 3).alias("instructions"), (k % 77).alias("read_bytes"), (k % 55).alias("write_bytes"))
    v1 = F.when(k % 4 < 2, F.struct(F.when(k % 4 == 0, data).alias("ext")))
    bump = F.when(k % 4 >= 2, F.struct(F.struct(F.when(k % 4 == 2, data).alias("ext")).alias("inner")))
    return t.orders.select(k, v1.alias("v1"), bump.alias("fee_bump"), views.cents("o_totalprice").alias("fee"))


@query("q82_contract_fields", "select o_orderkey, o_orderkey % 4 in (0, 2) as is_contract, case when o_orderkey % 4 in (0, 2) then o_orderkey % 1000 end as resource_fee, case when o_orderkey % 4 in (0, 2) then o_orderkey * 3 end as instructions, case when o_orderkey % 4 in (0, 2) then o_orderkey % 77 end as read_bytes, case when o_orderkey % 4 in (0, 2) then o_orderkey % 55 end as write_bytes, case when o_orderkey % 4 in (0, 2) then cast(round(o_totalprice * 100) as bigint) - o_orderkey % 1000 end as inclusion_bid from orders")
def q82(t: Tables) -> DataFrame:
    return pr.contract_fields(_contract_txs(t)).drop("v1", "fee_bump", "fee")


FEE_CHANGES = """fc as (select l_orderkey as tx, l_linenumber as k, case l_linenumber % 3 when 0 then 'created' when 1 then 'state' else 'updated' end as type, 's' || (l_suppkey % 2) as account, case when l_linenumber % 3 = 1 then 100000000 + l_partkey else l_partkey end as balance from lineitem)"""


@query("q82b_fees_from_changes", f"with {FEE_CHANGES}, b as (select tx, coalesce(arg_max(balance, k::bigint * 1000000000 + balance) filter (where type = 'state' and account = 's1'), 0) as before, coalesce(arg_max(balance, k::bigint * 1000000000 + balance) filter (where type = 'updated' and account = 's1'), 0) as after from fc group by tx) select tx, before, after, case when before >= after then before - after end as original_fee, case when before <= after then after - before end as refund from b")
def q82b(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(F.lit("created"), F.lit("state"), F.lit("updated")), (c("l_linenumber") % 3 + 1).cast("int"))
    entry = F.struct(c("l_linenumber").alias("k"), kind.alias("type"), F.concat(F.lit("s"), c("l_suppkey") % 2).alias("account"), F.when(c("l_linenumber") % 3 == 1, 100_000_000 + c("l_partkey")).otherwise(c("l_partkey")).alias("balance"))
    rows = t.lineitem.groupBy(c("l_orderkey").alias("tx")).agg(F.array_sort(F.collect_list(entry)).alias("x"))
    b = pr.balances(c("x"), F.lit("s1"))
    none = F.array().cast(rows.schema["x"].dataType)
    rows = rows.withColumns({"before": b["before"], "after": b["after"]})
    paid = F.when(c("before") >= c("after"), pr.original_fee(c("x"), F.lit("s1")))
    back = F.when(c("before") <= c("after"), pr.fee_refund(c("x"), none, F.lit("s1"), contract=F.lit(True)))
    return rows.select("tx", "before", "after", paid.alias("original_fee"), back.alias("refund"))


@query("q82c_fee_charged", "select o_orderkey, case when o_orderkey % 2 = 0 and o_orderkey % 3 = 0 and o_orderkey % 5 < 3 then c0 - o_orderkey % 50 else c0 end as charged, case when o_orderkey % 2 = 0 then c0 - o_orderkey % 1000 else c0 // (1 + o_orderkey % 4 + case when o_orderkey % 3 = 0 then 1 else 0 end) end as inclusion from (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as c0 from orders)")
def q82c(t: Tables) -> DataFrame:
    k, charged = c("o_orderkey"), views.cents("o_totalprice")
    fee = flatten.fee_charged(charged, k % 50, contract=k % 2 == 0, fee_bump=k % 3 == 0, protocol=F.when(k % 5 < 3, 20).otherwise(22))
    paid = flatten.inclusion_fee(charged, k % 1000, 1 + k % 4, contract=k % 2 == 0, fee_bump=k % 3 == 0)
    return t.orders.select("o_orderkey", fee.alias("charged"), paid.alias("inclusion"))


@query("q82d_resource_fees", "select o_orderkey, case when o_orderkey % 2 = 0 and o_orderkey % 3 = 0 then o_orderkey end as non_refundable, case when o_orderkey % 2 = 0 and o_orderkey % 3 = 0 then o_orderkey * 2 end as refundable, case when o_orderkey % 2 = 0 and o_orderkey % 3 = 0 then o_orderkey * 3 end as rent, case when o_orderkey % 2 = 0 then 1 else 0 end as n_slots, case when o_orderkey % 2 = 0 and o_orderkey % 5 > 0 then 1 else 0 end as n_events from orders")
def q82d(t: Tables) -> DataFrame:
    k = c("o_orderkey")
    ext = F.when(k % 3 == 0, F.struct(k.alias("non_refundable"), (k * 2).alias("refundable"), (k * 3).alias("rent")))
    v3 = F.when(k % 2 == 0, F.struct(F.struct(ext.alias("ext")).alias("contract")))
    slots = pr.slots(F.when(k % 5 > 0, F.array(F.lit("e"))), k % 2 == 0)
    return t.orders.select("o_orderkey", pr.resource_fees(v3).alias("f"), slots.alias("s")).select("o_orderkey", "f.*", F.size("s").alias("n_slots"), F.size(F.flatten("s")).alias("n_events"))


@query("q83_memos_and_bounds", "select o_orderkey, case o_orderkey % 4 when 1 then o_orderpriority when 2 then o_custkey::varchar when 3 then base64(encode(o_orderpriority)) else '' end as memo, case when o_orderkey % 3 > 0 then '[' || o_custkey || ',' || case when o_orderkey % 3 = 2 then (o_custkey + 5)::varchar else '' end || ')' end as bounds from orders")
def q83(t: Tables) -> DataFrame:
    k = c("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("none", "text", "id", "return")]), (k % 4 + 1).cast("int"))
    memo = flatten.memo_text(kind, c("o_orderpriority"), c("o_custkey"), F.encode("o_orderpriority", "UTF-8"))
    bounds = flatten.bounds_text(F.when(k % 3 > 0, c("o_custkey")), F.when(k % 3 == 2, c("o_custkey") + 5).otherwise(F.lit(0)))
    return t.orders.select("o_orderkey", memo.alias("memo"), bounds.alias("bounds"))


@query("q83b_strict_receive_source", "with a as (select l_orderkey, l_linenumber as k, l_partkey % 2 as asset, l_suppkey as amount, first_value(l_partkey % 2) over w as head, sum(case when l_partkey % 2 <> 0 then 1 else 0 end) over w as odd, row_number() over w as n from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey) window w as (partition by l_orderkey order by l_linenumber rows unbounded preceding)), r as (select *, bool_and(asset = head) over (partition by l_orderkey order by k rows unbounded preceding) as run from a) select l_orderkey, sum(amount) filter (where run)::bigint as amount from r group by 1")
def q83b(t: Tables) -> DataFrame:
    one = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x"))
    atom = F.struct(c("l_linenumber").alias("k"), (c("x.l_partkey") % 2).alias("asset_bought"), c("x.l_suppkey").alias("amount_bought"))
    rows = one.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(atom)).alias("atoms"))
    return rows.select("l_orderkey", flatten.receive_source_amount(F.lit(0).cast("long"), c("atoms")).alias("amount"))


@query("q83c_operations_with_transactions", "select l_orderkey, l_linenumber, o_orderkey is not null as has_transaction, o_custkey as account from lineitem left join (select * from orders where o_orderkey % 3 > 0) on o_orderkey = l_orderkey")
def q83c(t: Tables) -> DataFrame:
    txs = t.orders.where("o_orderkey % 3 > 0").select(c("o_orderkey").alias("hash"), "o_custkey")
    out = pr.with_transaction(t.lineitem.select(c("l_orderkey").alias("hash"), "l_linenumber"), txs)
    return out.select(c("hash").alias("l_orderkey"), "l_linenumber", c("transaction").isNotNull().alias("has_transaction"), c("transaction.o_custkey").alias("account"))


@query("q83d_sorted_by_hash", "select o_custkey, string_agg(h, ',' order by h) as hashes from (select o_custkey, md5(o_orderkey::varchar) as h from orders) group by 1")
def q83d(t: Tables) -> DataFrame:
    item = F.struct(F.md5(c("o_orderkey").cast("string")).alias("key"), c("o_orderkey"))
    rows = t.orders.groupBy("o_custkey").agg(F.collect_list(item).alias("items"))
    return rows.select("o_custkey", F.array_join(F.transform(flatten.sorted_by(c("items"), "key"), lambda x: x["key"]), ",").alias("hashes"))


@query("q83e_apply_order_pages", "select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from lineitem) where k >= 2 and k < 4")
def q83e(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = t.lineitem.withColumn("k", F.row_number().over(w))
    return paging.slice_from(rows, index="k", start=2, limit=2).select("l_orderkey", "l_linenumber", "l_partkey")


# ---- changes and entries

KINDS = list(pr.ENTRY_KEYS)


def _entry(t: Tables) -> DataFrame:
    k = c("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % 10 + 1).cast("int"))
    fields = sorted({f for fs in pr.ENTRY_KEYS.values() for f in fs})
    entry = F.struct(kind.alias("type"), *[F.concat(F.lit(f"{f}-"), k).alias(f) for f in fields])
    return t.part.select(k, F.when(k % 3 > 0, entry).alias("pre"), F.when(k % 3 < 2, entry).alias("post"))


_KEY_SQL = "case p_partkey % 10 " + " ".join(f"when {i} then '{k}'" + "".join(f" || '|{f}-' || p_partkey" for f in fs) for i, (k, fs) in enumerate(pr.ENTRY_KEYS.items())) + " end"


@query("q84_change_keys", f"select p_partkey, {_KEY_SQL} as key from part")
def q84(t: Tables) -> DataFrame:
    return _entry(t).select("p_partkey", pr.change_key(c("pre"), c("post")).alias("key"))


@query("q84b_accounts_changed", "select c_custkey, c_custkey % 7 = 0 or (c_custkey % 5 = 0 and c_custkey > 0) or (c_custkey % 6 = 1 and c_custkey % 3 > 0) as changed from customer")
def q84b(t: Tables) -> DataFrame:
    """Before: balance, liabilities missing in a third; after: the balance moved in a fifth, other signers everywhere, liabilities of 0 or 1."""
    k, fields = c("c_custkey"), ["balance", "buying_liabilities", "selling_liabilities", "num_sponsored"]
    side = lambda balance, buying, signers: F.struct(balance.alias("balance"), buying.cast("int").alias("buying_liabilities"), _null("int").alias("selling_liabilities"), F.lit(0).alias("num_sponsored"), F.array(F.lit(signers)).alias("signers"))
    pre = F.when(k % 7 > 0, side(k, F.when(k % 3 == 0, _null("int")).otherwise(F.lit(0)), "a"))
    post = side(F.when(k % 5 == 0, k * 2).otherwise(k), F.when((k % 6 == 1) & (k % 3 > 0), 1).otherwise(0), "b")
    return t.customer.select(k, pre.alias("pre"), post.alias("post")).select("c_custkey", pr.account_changed(c("pre"), c("post"), fields).alias("changed"))


@query("q84c_account_columns", "select c_custkey, c_custkey % 256 as master, (c_custkey + 1) % 256 as low, (c_custkey + 2) % 256 as medium, (c_custkey + 3) % 256 as high, case when c_custkey % 2 = 0 then 1 else 0 end + case when c_custkey % 256 > 0 then 1 else 0 end as n_weights, case when c_custkey % 3 = 0 then 'sponsor' end as sponsor from customer")
def q84c(t: Tables) -> DataFrame:
    k = c("c_custkey")
    packed = F.unhex(F.concat(*[F.lpad(F.hex((k + i) % 256), 2, "0") for i in range(4)]))
    signers = F.when(k % 2 == 0, F.array(F.struct(F.lit("x").alias("key"), F.lit(3).alias("weight")))).otherwise(F.array().cast("array<struct<key:string,weight:int>>"))
    rows = t.customer.select(k, pr.thresholds(packed).alias("t"), signers.alias("s"))
    weights = flatten.signer_weights(c("s"), F.lit("me"), c("t.master"))
    sponsors = pr.signer_sponsors(F.array(F.lit("x"), F.lit("y")), F.array(F.when(k % 3 == 0, F.lit("sponsor")), _null("string")))
    return rows.select(k, "t.*", F.size(weights).alias("n_weights"), F.try_element_at(sponsors, F.lit("x")).alias("sponsor"))


@query("q84d_claims", "select l_orderkey, l_linenumber, case l_linenumber % 3 when 2 then 'pool' else 's' || l_suppkey end as seller, 'a' || (l_partkey % 9) as sold, l_partkey as sold_amount, 'b' || (l_suppkey % 9) as bought, l_suppkey as bought_amount from lineitem")
def q84d(t: Tables) -> DataFrame:
    n = c("l_linenumber") % 3
    body = [F.concat(F.lit("a"), c("l_partkey") % 9).alias("sold"), c("l_partkey").alias("sold_amount"), F.concat(F.lit("b"), c("l_suppkey") % 9).alias("bought"), c("l_suppkey").alias("bought_amount")]
    seller = F.concat(F.lit("s"), c("l_suppkey")).alias("seller")
    atom = F.struct(F.when(n == 0, F.struct(seller, *body)).alias("v0"), F.when(n == 1, F.struct(seller, *body)).alias("book"), F.when(n == 2, F.struct(F.lit("pool").alias("pool_id"), *body)).alias("pool"))
    return t.lineitem.select("l_orderkey", "l_linenumber", pr.claim(atom).alias("x")).select("l_orderkey", "l_linenumber", "x.*")


RESULTS = {("payment", 0): "PaymentSuccess", ("payment", -2): "PaymentUnderfunded", ("create_account", 0): "CreateAccountSuccess"}


@query("q84e_results", "select o_orderkey, case when o_orderkey % 3 = 0 then 'PaymentSuccess' when o_orderkey % 3 = 1 then 'PaymentUnderfunded' when o_orderkey % 2 = 0 then 'CreateAccountSuccess' end as result, case when o_orderkey % 4 < 2 then 'b' || o_orderkey || '-' || (o_orderkey % 4) end as balance_id from orders")
def q84e(t: Tables) -> DataFrame:
    k = c("o_orderkey")
    name = pr.result_name(F.when(k % 3 < 2, F.lit("payment")).otherwise(F.lit("create_account")), F.when(k % 3 == 1, -2).when((k % 3 == 2) & (k % 2 == 1), -9).otherwise(0), RESULTS)
    results = F.array(*[F.struct(F.concat(F.lit("b"), k, F.lit(f"-{i}")).alias("balance_id")) for i in (0, 1)])
    return t.orders.select("o_orderkey", name.alias("result"), pr.balance_id(results, k % 4).alias("balance_id"))


RESTORED = f"""{CHANGES}, c as (select user_id, day, case when event_type = 'signup' then 'restored' when event_type = 'error' then 'removed' else 'updated' end as kind, case when event_type = 'signup' then null else value end as pre, case when event_type = 'error' then null else value end as post, k
 from (select ch.*, e.event_type, row_number() over (partition by ch.user_id, day order by ms, ch.event_id) as k from ch join events e on e.event_id = ch.event_id))"""


@query("q85_restored_and_longest", f"""with recursive {RESTORED},
f(user_id, day, k, kind, pre, post) as (
  select user_id, day, k, kind, pre, post from c where k = 1
  union all
  select c.user_id, c.day, c.k,
    case when f.kind = 'error' then 'error' when f.kind is null then c.kind when c.kind = 'updated' and f.kind in ('updated', 'restored') then f.kind when c.kind = 'removed' and f.kind in ('updated', 'restored') then 'removed' else 'error' end,
    case when f.kind = 'error' then f.pre when f.kind is null then c.pre when c.kind = 'updated' and f.kind in ('updated', 'restored') then f.pre when c.kind = 'removed' and f.kind = 'updated' then f.pre when c.kind = 'removed' and f.kind = 'restored' then c.pre end,
    case when f.kind = 'error' then f.post when f.kind is null then c.post when c.kind = 'updated' and f.kind in ('updated', 'restored') then greatest(f.post, c.post) end
  from f join c on c.user_id = f.user_id and c.day = f.day and c.k = f.k + 1),
l as (select *, row_number() over (partition by user_id, day order by k desc) as r from f)
select user_id, day, kind, pre, post from l where r = 1 and kind is not null""")
def q85(t: Tables) -> DataFrame:
    """Restored entries, kept removals and the longest time to live."""
    rows = views.changes(t)
    kind = F.when(c("kind") == "created", F.lit("restored")).otherwise(c("kind"))
    rows = rows.select("user_id", "day", "ms", "event_id", kind.alias("kind"), F.when(c("kind") != "created", c("value")).alias("pre"), F.when(c("kind") != "removed", c("value")).alias("post"))
    return ch.compacted(rows, keys=["user_id", "day"], order=["ms", "event_id"], suppress_remove_after_restore=False, longest=True, on_error="mark")


@query("q85b_expiring_rows", "with k as (select sha256(cast(c_custkey as varchar)) as hash, c_custkey from customer), x as (select sha256(cast(o_custkey as varchar)) as hash, max(epoch_us(o_orderdate) // 1000) as live_until from orders group by 1), m as (select min(live_until) + (max(live_until) - min(live_until)) // 2 as cut from x) select c_custkey, live_until from k join x using (hash), m where live_until <= cut")
def q85b(t: Tables) -> DataFrame:
    """Entries whose time to live ends in the first half of all times to live."""
    hashed = lambda x: F.sha2(c(x).cast("string"), 256).alias("hash")
    k = t.customer.select(hashed("c_custkey"), "c_custkey")
    x = t.orders.groupBy(hashed("o_custkey")).agg(F.max(views.epoch_ms(c("o_orderdate"))).alias("live_until"))
    low, high = x.agg(F.min("live_until"), F.max("live_until")).first()
    return k.join(x, "hash").where(c("live_until") <= F.lit(0 if low is None else low + (high - low) // 2)).select("c_custkey", "live_until")


@query("q85c_bucket_order", "with b as (select user_id, event_id, event_type, event_id % 11 as level, event_id % 2 as snap from events where event_id % 13 > 0), r as (select *, row_number() over (partition by user_id order by level, snap, event_id) as k from b) select user_id, event_id, level::int as level, snap::int as snap from r where k = 1 and event_type <> 'error'")
def q85c(t: Tables) -> DataFrame:
    """The newest bucket's entry of each key: level by level, the current one before the snapshot; empty buckets are not read."""
    k = c("event_id")
    rows = t.events.where("event_id % 13 > 0").select("user_id", "event_id", "event_type", (k % 11).cast("int").alias("level"), (k % 2).cast("int").alias("snap"))
    return snapshot.newest(rows, keys=["user_id"], newest_first=[snapshot.layer_rank(c("level"), F.when(c("snap") == 1, "snap").otherwise("curr")), k], dead=c("event_type") == "error").drop("event_type")


@query("q86_checkpoint_log", "with s as (select distinct o_orderkey // 64 * 64 + 63 as checkpoint from orders), h as (select o_orderkey // 64 * 64 + 63 as checkpoint, arg_max(epoch_us(o_orderdate) // 1000, o_orderkey) as closed, sum(o_custkey)::bigint as txs from orders group by 1), m as (select checkpoint, case when checkpoint // 64 % 2 = 0 then 'a' else 'b' end as curr from s) select s.checkpoint, closed, txs, case when p.checkpoint is not null then case when p.curr = m.curr then '_' else '#' end || '_' end as changed, '#' as occupied from s join m using (checkpoint) left join h using (checkpoint) left join m p on p.checkpoint = s.checkpoint - 64")
def q86(t: Tables) -> DataFrame:
    k = c("o_orderkey")
    point = F.floor(k / 64) * 64 + 63
    states = t.orders.select(point.cast("long").alias("checkpoint")).distinct()
    level = F.struct(F.when(F.floor(c("checkpoint") / 64) % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("curr"), _null("string").alias("snap"), _null("string").alias("next"))
    headers = t.orders.select(k.alias("sequence"), views.epoch_ms(c("o_orderdate")).alias("close_time"), c("o_custkey").alias("tx_count"))
    return archives.checkpoint_log(states.withColumn("levels", F.array(level)), headers)


@query("q86b_scan_status", "select o_orderkey, case when asc_ and cur > 4000 or not asc_ and cur < 500 then 'COMPLETE' when asc_ and cur > 3000 then 'WAITING_FOR_LEDGERS' when not asc_ and cur < 1000 then 'OLDEST_REACHED' else 'HAS_MORE' end as status from (select o_orderkey, o_orderkey % 6000 as cur, o_orderkey % 2 = 0 as asc_ from orders)")
def q86b(t: Tables) -> DataFrame:
    lit = lambda n: F.lit(n)
    status = pr.scan_status(cursor=c("o_orderkey") % 6000, first=lit(500), last=lit(4000), oldest=lit(1000), newest=lit(3000), ascending=c("o_orderkey") % 2 == 0)
    return t.orders.select("o_orderkey", status.alias("status"))


@query("q86c_repair_list", "with p as (select distinct (l_orderkey + 64) // 64 * 64 - 1 as checkpoint, case l_linenumber % 2 when 0 then 'ledger' else 'results' end as category from lineitem), d as (select distinct (l_orderkey + 64) // 64 * 64 - 1 as checkpoint, case l_linenumber % 2 when 0 then 'ledger' else 'results' end as category from lineitem where l_quantity > 49) select category, checkpoint, category || '/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || substr(h, 5, 2) || '/' || category || '-' || h || '.xdr.gz' as path from (select *, printf('%08x', checkpoint) as h from p where not exists (select 1 from d where d.checkpoint = p.checkpoint and d.category = p.category))")
def q86c(t: Tables) -> DataFrame:
    """What a copy of an archive lacks of the original, as paths to copy."""
    files = lambda df: df.select(F.when(c("l_linenumber") % 2 == 0, F.lit("ledger")).otherwise(F.lit("results")).alias("category"), ids.next_checkpoint(c("l_orderkey")).alias("checkpoint")).distinct()
    lost = archives.missing(files(t.lineitem), files(t.lineitem.where("l_quantity > 49")), keys=["category", "checkpoint"])
    return lost.withColumn("path", ids.category_path(c("category"), c("checkpoint")))


@query("q86d_offers_and_pools", "select case when p_partkey % 4 = 0 then 'pool' else 'offer' end as dump, count(*) as n, sum(p_size)::bigint as size from part where p_partkey % 5 < 3 or p_partkey % 4 = 0 group by 1")
def q86d(t: Tables) -> DataFrame:
    """Offers and pools of a state by type, each with its own columns, as two dumps have them."""
    k = c("p_partkey")
    state = t.part.select(F.when(k % 4 == 0, F.lit("liquidity_pool")).when(k % 5 < 3, F.lit("offer")).otherwise(F.lit("account")).alias("type"), c("p_size").cast("long").alias("size"))
    offers, pools = tables.split_by_type(state, ["offer", "liquidity_pool"], column="type")
    named = lambda df, name: df.groupBy(F.lit(name).alias("dump")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    return named(offers, "offer").unionByName(named(pools, "pool"))


@query("q86e_differing_responses", "with a as (select o_orderkey as k, o_custkey as v from orders where o_orderkey % 10 > 0), b as (select o_orderkey as k, case when o_orderkey % 7 = 0 then -1 else o_custkey end as v from orders where o_orderkey % 11 > 0) select '/x/' || k as path, case when a.v is not null then '{\"v\":' || a.v || ',\"u\":\"/x\"}' end as body_a, case when b.v is not null then '{\"v\":' || b.v || ',\"u\":\"/x\"}' end as body_b from a full join b using (k) where a.v is distinct from b.v")
def q86e(t: Tables) -> DataFrame:
    k = c("o_orderkey")

    def server(rows: DataFrame, v, host: str) -> DataFrame:
        body = F.concat(F.lit('{"latest_ledger": '), F.lit(str(len(host) * 100)), F.lit(',"v":'), v, F.lit(f',"u":"{host}/x"}}'))
        return rows.select(F.concat(F.lit("/x/"), k).alias("path"), pr.response_body(body, F.lit(host)).alias("body"))

    a = server(t.orders.where("o_orderkey % 10 > 0"), c("o_custkey").cast("string"), "https://one")
    b = server(t.orders.where("o_orderkey % 11 > 0"), F.when(k % 7 == 0, F.lit("-1")).otherwise(c("o_custkey").cast("string")), "https://another")
    return pr.differing_responses(a, b)


# ---- small codecs


@query("q87_wide_numbers", "with n as (select l_orderkey, l_linenumber, (case when l_suppkey % 2 = 0 then 1 else -1 end * l_partkey::hugeint * 46116860184273) as hi, (l_extendedprice * 100)::bigint::hugeint * 1000000007 * 1000 % 18446744073709551616::hugeint as lo from lineitem), v as (select *, hi * 18446744073709551616::hugeint + lo as v from n), a as (select *, abs(v)::varchar as digits from v) select l_orderkey, l_linenumber, v::varchar as raw, case when v < 0 then '-' else '' end || left(lpad(digits, greatest(length(digits), 8)::int, '0'), -7) || '.' || right(lpad(digits, greatest(length(digits), 8)::int, '0'), 7) as text from a")
def q87(t: Tables) -> DataFrame:
    """128-bit amounts from their halves, as whole numbers and with seven places; the parts from 200,001 on make numbers beyond 128 bits, as exact."""
    part = c("l_partkey").cast("decimal(19,0)")
    high = F.when(c("l_suppkey") % 2 == 0, part).otherwise(-part) * F.lit("46116860184273").cast("decimal(14,0)")
    low = F.pmod(views.cents("l_extendedprice").cast("decimal(19,0)") * F.lit("1000000007000").cast("decimal(13,0)"), F.lit("18446744073709551616").cast("decimal(20,0)"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", money.wide_text_from_halves(high, low).alias("raw"))
    return rows.withColumn("text", money.long_amount_text(c("raw")))


@query("q87b_number_texts", "select o_orderkey, cents::decimal(38, 0) as raw, printf('%.7f', o_totalprice) as float_text, cast(cast(o_custkey as decimal(20, 0)) / 4 as decimal(30, 7))::varchar as price from (select *, cast(round(o_totalprice * 100) as bigint) as cents from orders)")
def q87b(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", money.parse_raw(views.cents("o_totalprice").cast("string")).alias("raw"), money.float_text(c("o_totalprice")).alias("float_text"), money.price_text(c("o_custkey"), F.lit(4)).alias("price"))


@query("q87c_prices_from_text", "select distinct l_quantity::bigint // gcd(l_quantity::bigint, 8) as n, 8 // gcd(l_quantity::bigint, 8) as d, printf('%.3f', l_quantity::bigint / 8.0) as text from lineitem where l_quantity > 0")
def q87c(t: Tables) -> DataFrame:
    text = F.format_string("%.3f", c("l_quantity").cast("long") / F.lit(8.0))
    rows = t.lineitem.where("l_quantity > 0").select(text.alias("text")).distinct()
    return rows.select("text", money.parse_price(c("text")).alias("p")).select(c("p.n").cast("long").alias("n"), c("p.d").cast("long").alias("d"), "text")


@query("q88_addresses", "select c_custkey, k.letter, k.size as length, sha256(c_custkey::varchar) as key, k.kind, true as same, true as refused from customer, (select unnest(['G', 'S', 'C', 'L', 'X', 'T']) as letter, unnest([56, 56, 56, 56, 56, 56]) as size, unnest(['account', 'seed', 'contract', 'pool', 'hash_x', 'pre_auth_tx']) as kind) k")
def q88(t: Tables) -> DataFrame:
    """Keys as addresses of six kinds and back; one changed character is refused."""
    key = F.unhex(F.sha2(c("c_custkey").cast("string"), 256))
    rows = None
    for kind in ("account", "seed", "contract", "pool", "hash_x", "pre_auth_tx"):
        one = t.customer.select("c_custkey", address.encoder(kind)(key).alias("a"), F.lit(kind).alias("kind"))
        back, bad = address.decoder(kind), F.concat(F.substring("a", 1, 20), F.when(F.substring("a", 21, 1) == "A", F.lit("B")).otherwise(F.lit("A")), F.substring("a", 22, 40))
        one = one.select("c_custkey", "a", "kind", back(c("a")).alias("key"), back(bad).isNull().alias("refused"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("c_custkey", F.substring("a", 1, 1).alias("letter"), F.length("a").alias("length"), F.lower(F.hex("key")).alias("key"), "kind", (address.kind_of(c("a")) == c("kind")).alias("same"), "refused")


@query("q88b_muxed_and_signed", "select c_custkey, sha256(c_custkey::varchar) as account_key, c_custkey::decimal(20, 0) as id, sha256(c_custkey::varchar) as signer, left(md5(c_custkey::varchar), (2 * (1 + c_custkey % 16))::int) as payload from customer")
def q88b(t: Tables) -> DataFrame:
    """Accounts with a number, and signers with a payload, packed into addresses and taken apart."""
    k = c("c_custkey")
    key = F.unhex(F.sha2(k.cast("string"), 256))
    muxed = address.encoder("muxed")(F.concat(key, F.unhex(F.lpad(F.hex(k), 16, "0"))))
    payload = F.unhex(F.substring(F.md5(k.cast("string")), F.lit(1), (2 * (1 + k % 16)).cast("int")))
    rows = t.customer.select("c_custkey", address.muxed_parts(muxed).alias("m"), address.signed_payload_parts(address.signed_payload(key, payload)).alias("p"))
    return rows.select("c_custkey", F.lower(F.hex(address.decoder("account")(c("m.account")))).alias("account_key"), c("m.id").alias("id"), F.lower(F.hex("p.key")).alias("signer"), F.lower(F.hex("p.payload")).alias("payload"))


@query("q88c_asset_order", "select p_partkey, row_number() over (partition by p_size order by case p_partkey % 3 when 0 then 0 when 1 then 1 else 2 end, case when p_partkey % 3 = 0 then '' else p_brand end, case when p_partkey % 3 = 0 then '' else md5(p_partkey::varchar) end, p_partkey) as place from part")
def q88c(t: Tables) -> DataFrame:
    k = c("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("native", "credit_alphanum4", "credit_alphanum12")]), (k % 3 + 1).cast("int"))
    order = pr.asset_order(kind, F.when(k % 3 > 0, c("p_brand")), F.when(k % 3 > 0, F.unhex(F.md5(k.cast("string")))))
    return t.part.select("p_partkey", F.row_number().over(Window.partitionBy("p_size").orderBy(order, k)).cast("long").alias("place"))


@query("q88d_asset_texts", "select p_partkey, case when p_partkey % 3 = 0 then 'native' when p_partkey % 3 = 1 then 'A' || (p_partkey % 9) end as code, case when p_partkey % 3 = 1 then 'G' || p_partkey end as issuer, 'n' || p_partkey as name, case when p_partkey % 2 = 0 then 'd.org' end as domain from part")
def q88d(t: Tables) -> DataFrame:
    k = c("p_partkey")
    text = F.when(k % 3 == 0, F.lit("native")).when(k % 3 == 1, F.concat(F.lit("A"), k % 9, F.lit(":G"), k)).otherwise(F.lit("bad:::"))
    parts = assets.address_parts(F.concat(F.lit("n"), k, F.when(k % 2 == 0, F.lit("*d.org")).otherwise(F.lit("*"))))
    rows = t.part.select(k, assets.parse_one(text).alias("a"), parts.alias("p"), F.concat(F.lit("n"), k).alias("name"))
    return rows.select("p_partkey", "a.code", "a.issuer", "name", c("p.domain").alias("domain"))


@query(
    "q88e_prefixes_and_ranges",
    """with r as (select o_custkey, min(o_orderkey) * 7 as low, max(o_orderkey) * 7 as high from orders group by 1),
p as (select o_custkey, low, high, [substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || substr(h, 5, 2) for h in [printf('%08x', x) for x in range(((low + 64) // 64 * 64 - 1)::bigint, ((high + 64) // 64 * 64)::bigint, 64)]] as every from r)
select o_custkey, low * 4294967296 as low, (high + 1) * 4294967296 as high, array_to_string(list_sort(list_distinct(every)), ',') as prefixes from p""",
)
def q88e(t: Tables) -> DataFrame:
    """The folders and positions of the ledgers between each customer's first and last.

    The ranges are a few bytes each and their texts a thousand times that, so the ranges are dealt to all tasks first, in
    order: neighbours share much of their text then, and files of them are smaller.
    """
    rows = t.orders.groupBy("o_custkey").agg((F.min("o_orderkey") * 7).alias("first"), (F.max("o_orderkey") * 7).alias("last"))
    place = ["first", "last", "o_custkey"]
    rows = rows.repartitionByRange(int(t.spark.conf.get("spark.sql.shuffle.partitions")), *place).sortWithinPartitions(*place)
    low, high = ids.position_range(c("first"), c("last"))
    return rows.select("o_custkey", low.alias("low"), high.alias("high"), ids.path_prefix_text(c("first"), c("last")).alias("prefixes"))


@query("q88f_halves_and_hours", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_partkey - 1000)::hugeint * 18446744073709551616 + l_suppkey::hugeint * 180000000000000000)::decimal(38, 0) as whole, (epoch_us(l_shipdate) // 1000 + l_partkey + 3599999) // 3600000 * 3600000 as hour from lineitem where l_suppkey < 100")
def q88f(t: Tables) -> DataFrame:
    """Numbers of 128 bits from their halves, and times rounded up to hours; the low half stays below 2^64 for the suppliers up to 99."""
    high, low = c("l_partkey") - 1000, c("l_suppkey").cast("decimal(20,0)") * F.lit(180_000_000_000_000_000).cast("decimal(18,0)")
    rows = t.lineitem.where("l_suppkey < 100")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money.from_halves(high, low.cast("decimal(20,0)")).alias("whole"), timing.round_up(views.epoch_ms(c("l_shipdate")) + c("l_partkey"), 3_600_000).alias("hour"))


@query("q88g_pool_changes", "select p_partkey, 'A' as asset, case p_partkey % 3 when 0 then p_size when 1 then 10 * p_size else 9 * p_size end as amount from part union all select p_partkey, 'B', case p_partkey % 3 when 0 then 5 when 1 then p_partkey else abs(p_partkey - 5) end from part")
def q88g(t: Tables) -> DataFrame:
    """How far each reserve of a pool moved: pools that appear, go and change."""
    k, size = c("p_partkey"), c("p_size").cast("long")
    state = lambda a, b: F.struct(F.lit("A").alias("asset_a"), F.lit("B").alias("asset_b"), a.alias("reserve_a"), b.alias("reserve_b"))
    before, after = state(size, F.lit(5).cast("long")), state(size * 10, k)
    rows = t.part.select("p_partkey", F.concat(F.lit("L"), k).alias("pool_id"), F.when(k % 3 != 1, before).alias("pre"), F.when(k % 3 != 0, after).alias("post"))
    return deltas.pool_changes(rows, keys=["p_partkey"]).drop("pool_id")


# ---- JSON


@query("q89_operations_from_json", "select l_orderkey || '-' || l_linenumber as id, 'payment' as type, 's' || l_suppkey as source, l_partkey::varchar as amount, null as n_claimants from lineitem where l_linenumber % 3 = 1 union all select l_orderkey || '-' || l_linenumber, 'create_claimable_balance', 's' || l_suppkey, l_partkey::varchar, 2 from lineitem where l_linenumber % 3 = 2")
def q89(t: Tables) -> DataFrame:
    n = c("l_linenumber") % 3
    kind = F.when(n == 1, F.lit("payment")).when(n == 2, F.lit("create_claimable_balance")).otherwise(F.lit("inflation"))
    claimants = F.when(n == 2, F.array(*[F.struct(F.lit(x).alias("destination")) for x in "ab"]))
    body = F.to_json(F.struct(F.concat(c("l_orderkey"), F.lit("-"), c("l_linenumber")).alias("id"), kind.alias("type"), F.when(n == 1, 1).when(n == 2, 14).otherwise(9).alias("type_i"), F.concat(F.lit("s"), c("l_suppkey")).alias("source_account"), c("l_partkey").cast("string").alias("amount"), claimants.alias("claimants")))
    rows = t.lineitem.select(body.alias("j"))
    out = jf.typed_operations(rows, "j").where(c("type_i").isin(1, 14))
    return out.select("id", "type", c("source_account").alias("source"), F.coalesce("own_1.amount", "own_14.amount").alias("amount"), F.when(c("own_14").isNotNull(), F.size("own_14.claimants")).alias("n_claimants"))


@query("q89b_effects_from_json", "select event_id::varchar as id, event_type as type, 'u' || user_id as account, (event_id % 50)::int as type_i, json_extract_string(props, '$.k') as k from events")
def q89b(t: Tables) -> DataFrame:
    body = F.to_json(F.struct(c("event_id").cast("string").alias("id"), c("event_type").alias("type"), F.concat(F.lit("u"), c("user_id")).alias("account"), (c("event_id") % 50).alias("type_i"), F.get_json_object("props", "$.k").alias("k")))
    out = jf.effect_rows(t.events.select(body.alias("j")), "j")
    return out.select("id", "type", "account", "type_i", F.try_element_at("details", F.lit("k")).alias("k"))


@query("q89c_predicates", "select o_orderkey, case o_orderkey % 5 when 0 then 'unconditional' when 1 then 'rel_before' when 2 then 'abs_before' when 3 then 'not' else 'and' end as kind, case o_orderkey % 5 when 1 then o_custkey when 2 then epoch_us(o_orderdate) // 1000000 end as seconds, case o_orderkey % 5 when 3 then 1 when 4 then 2 end as n_parts, true as round_trip from orders")
def q89c(t: Tables) -> DataFrame:
    k = c("o_orderkey")
    seconds = F.floor(views.epoch_ms(c("o_orderdate")) / 1000)
    iso = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    any_, rel = F.lit('{"unconditional":true}'), F.concat(F.lit('{"rel_before":"'), c("o_custkey"), F.lit('"}'))
    text = F.when(k % 5 == 0, any_).when(k % 5 == 1, rel).when(k % 5 == 2, F.concat(F.lit('{"abs_before":"'), iso, F.lit('","abs_before_epoch":"'), seconds, F.lit('"}'))).when(k % 5 == 3, F.concat(F.lit('{"not":'), rel, F.lit("}"))).otherwise(F.concat(F.lit('{"and":['), any_, F.lit(","), rel, F.lit("]}")))
    rows = t.orders.select("o_orderkey", text.alias("j"), jf.predicate(text).alias("p"))
    again = jf.predicate_json(c("p.kind"), c("p.seconds"), c("p.parts"))
    return rows.select("o_orderkey", "p.kind", "p.seconds", F.when(c("p.parts").isNotNull(), F.size("p.parts")).alias("n_parts"), (again == c("j")).alias("round_trip"))


@query("q89d_prices_and_types", "select p_partkey, case when p_partkey % 7 > 0 then p_partkey end as n, p_size::bigint as d, case p_partkey % 3 when 0 then 'contract,system' when 1 then 'system' else '' end as types from part")
def q89d(t: Tables) -> DataFrame:
    k = c("p_partkey")
    quoted = lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('"'))
    n = F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit('"n":'), F.when(k % 2 == 0, quoted(k)).otherwise(k.cast("string")), F.lit(",")))
    text = F.concat(F.lit("{"), n, F.lit('"d":'), quoted(c("p_size")), F.lit("}"))
    types = jf.event_types(F.when(k % 3 == 0, F.lit("system, contract,system")).when(k % 3 == 1, F.lit("system")).otherwise(F.lit("")))
    return t.part.select(k, jf.price(text).alias("p"), types.alias("t")).select("p_partkey", "p.n", "p.d", F.array_join("t", ",").alias("types"))
