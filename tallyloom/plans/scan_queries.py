"""Queries over bucket scans, histories, events by version and checks of requests, made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.operators import buckets, event_filters, fees, flatten, paging, projections as pr
from tallyloom.plans import views
from tallyloom.plans.registry import Tables, query
from tallyloom.sinks import scratch
from tallyloom.sources import history

c = F.col


def _bucket(b: Column) -> Column:
    return F.sha2(F.concat(F.lit("bucket "), b.cast("string")), 256)


def _state(t: Tables) -> DataFrame:
    """Eleven levels of two slots, that of bucket 7 empty."""
    slot = lambda b: F.lit(buckets.ZERO) if b == 7 else _bucket(F.lit(b))
    levels = F.array(*[F.struct(slot(2 * i).alias("curr"), slot(2 * i + 1).alias("snap")) for i in range(11)])
    return t.region.agg(F.lit(127).alias("sequence"), levels.alias("levels"))


def _records(t: Tables, kind: Column, list_kind: str) -> DataFrame:
    """The last event of each user in each of 22 buckets, in order of events, after a first record that says what the bucket is."""
    b = c("event_id") % 22
    last = t.events.groupBy("user_id", b.alias("b")).agg(F.max(F.struct("event_id", "event_type", "value")).alias("e"))
    rows = last.select("b", c("user_id").alias("key"), "e.*")
    entries = rows.select(_bucket(c("b")).alias("hash"), (c("event_id") + 1).alias("n"), kind.alias("kind"), "key", F.when(c("key") % 3 == 0, "offer").otherwise("account").alias("type"), views.cents("value").alias("value"), "event_id")
    metas = t.events.select(b.alias("b")).distinct().select(_bucket(c("b")).alias("hash"), F.lit(0).alias("n"), F.lit("meta").alias("kind"), F.lit(22).alias("protocol"), F.lit(list_kind).alias("list_type"))
    return entries.unionByName(metas, allowMissingColumns=True)


LAST = """l as (select user_id as key, event_id % 22 as b, max(event_id) as event_id from events group by 1, 2),
r as (select l.*, event_type, case when user_id % 3 = 0 then 'offer' else 'account' end as type, cast(round(value * 100) as bigint) as value from l join events using (event_id) where b <> 7)"""


@query(
    "q100_live_buckets",
    f"""with {LAST}, f as (select * from r where case when event_type = 'error' then key % 10 > 0 else value % 4 > 0 end),
v as (select *, max(case when event_type <> 'signup' then b end) over w as hid, max(case when event_type = 'signup' and type = 'offer' then b end) over w as cleared from f window w as (partition by key order by b rows between unbounded preceding and 1 preceding))
select key, event_id, b::int as rank from v where event_type <> 'error' and not coalesce(hid > coalesce(cleared, -1), false)""",
)
def q100(t: Tables) -> DataFrame:
    """Users as keys, errors as dead keys, signups as entries that are new; filters of entries and of dead keys."""
    kind = F.when(c("event_type") == "signup", "init").when(c("event_type") == "error", "dead").otherwise("live")
    found = buckets.live_entries(_records(t, kind, buckets.LIVE), buckets.listed(_state(t), sequence=127), keep_entry=c("value") % 4 > 0, keep_key=c("key") % 10 > 0)
    return found.select("key", "event_id", "rank")


@query("q100b_archived_entries", f"with {LAST}, n as (select key, arg_min(event_id, b) as event_id, arg_min(event_type, b) as event_type, min(b)::int as rank from r group by 1) select key, event_id, rank from n where event_type <> 'signup'")
def q100b(t: Tables) -> DataFrame:
    """Signups bring a user back, so what was archived before is none of the list's entries."""
    kind = F.when(c("event_type") == "signup", "live").otherwise("archived")
    return buckets.archived_entries(_records(t, kind, buckets.HOT), buckets.listed(_state(t), sequence=127)).select("key", "event_id", "rank")


@query(
    "q100c_bucket_faults",
    """with l as (select distinct l_orderkey as k, l_linenumber as line from lineitem), p as (select k, row_number() over (partition by k order by line) - 1 as n from l),
r as (select *, case when n = 0 and k % 13 > 0 or n = 2 and k % 7 = 0 then 'meta' when n = 1 and k % 5 = 0 then 'init' when n = 3 and k % 17 = 0 then 'odd' else 'live' end as kind from p),
f as (select *, case when kind = 'odd' then 'unknown kind' when kind = 'meta' and n > 0 then 'meta not first' when kind = 'meta' and k % 11 = 0 then 'bucket of another list' when kind = 'init' and (k % 3 = 0 or k % 13 = 0) then 'init before protocol 11' end as fault from r)
select k, min(n) filter (where fault is not null) as n, arg_min(fault, n) filter (where fault is not null) as fault from f group by 1""",
)
def q100c(t: Tables) -> DataFrame:
    """Orders as buckets with a record a line, many of them such as no live list may hold."""
    k, n = c("k"), c("n")
    lines = t.lineitem.groupBy(c("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines"))
    rows = lines.select("k", F.posexplode("lines").alias("n", "line"))
    kind = F.when((n == 0) & (k % 13 > 0) | (n == 2) & (k % 7 == 0), "meta").when((n == 1) & (k % 5 == 0), "init").when((n == 3) & (k % 17 == 0), "odd").otherwise("live")
    of_list = F.when(k % 11 == 0, buckets.HOT).when(k % 2 == 0, buckets.LIVE)
    return buckets.record_faults(rows.select(k.alias("hash"), "n", kind.alias("kind"), F.when(k % 3 == 0, 10).otherwise(22).alias("protocol"), of_list.alias("list_type")), list_kind=buckets.LIVE).withColumnRenamed("hash", "k")


@query(
    "q101_events_by_version",
    """with o as (select o_orderkey as k from orders), l as (select distinct l_orderkey as k, l_linenumber as line from lineitem where l_orderkey in (select k from o)),
p as (select *, row_number() over (partition by k order by line) as op from l), g as (select unnest([true, false]) as gated),
t as (select *, not gated or k % 2 = 0 as called from o, g),
r as (select k, gated, 'transaction' as part, null::bigint as op_index, 0::bigint as at, 'fee ' || k as event from t where k % 5 = 4
union all select k, gated, 'operation', op, i, 'e ' || k || ' ' || line || ' ' || i from (select p.*, gated, unnest(range(line % 3)) as i from p, g where k % 5 = 4)
union all select k, gated, 'operation', 1, i, 'c ' || k || ' ' || i from (select t.*, unnest(range(2)) as i from t where k % 5 = 3 and k % 3 > 0 and called)
union all select k, gated, 'diagnostic', null, 0, 'd ' || k from t where k % 7 = 0 and (k % 5 = 4 or k % 5 = 3 and k % 3 > 0 and called))
select * from r""",
)
def q101(t: Tables) -> DataFrame:
    """Orders as transactions of all versions of meta, with their events as contract calls only have them (gated) and as they lie."""
    k = c("k")
    lines = t.lineitem.groupBy(c("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines"))
    rows = t.orders.select(c("o_orderkey").alias("k")).join(lines, "k", "left")
    text = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    operations = F.transform("lines", lambda line: F.struct(F.transform(upto((line % 3).cast("int")), lambda i: text("e", k, line, i)).alias("events")))
    diagnostics = F.when(k % 7 == 0, F.array(text("d", k)))
    part = F.when(k % 3 > 0, F.struct(F.array(text("c", k, F.lit(0)), text("c", k, F.lit(1))).alias("events"), diagnostics.alias("diagnostics")))
    meta = F.struct((k % 5).alias("version"), part.alias("contract"), F.array(text("fee", k)).alias("events"), operations.alias("operations"), diagnostics.alias("diagnostics"))
    rows = rows.select("k", meta.alias("meta"))
    sides = [flatten.event_rows(rows.withColumn("events", flatten.meta_events(c("meta"), contract=gate)), keep=["k"]).withColumn("gated", F.lit(gate is not None)) for gate in (k % 2 == 0, None)]
    return sides[0].unionByName(sides[1])


@query(
    "q20b_fees_by_results",
    """with l as (select l_orderkey as k, count(*) as n from lineitem group by 1), o as (select o_orderkey as k, coalesce(n, 0) as n, cast(round(o_totalprice * 100) as bigint) as charged from orders left join l on k = o_orderkey),
r as (select k, charged, case when k % 5 < 2 then n when k % 5 < 4 and k % 3 < 2 then n + 1 else 0 end as operations from o)
select k, operations, case when operations > 0 then charged // operations end as fee from r""",
)
def q20b(t: Tables) -> DataFrame:
    """Fees an operation, as results list them: own ones, those of the inner transaction, or none."""
    k = c("k")
    lines = t.lineitem.groupBy(c("l_orderkey").alias("k")).agg(F.collect_list("l_linenumber").alias("lines"))
    rows = t.orders.select(c("o_orderkey").alias("k"), views.cents("o_totalprice").alias("charged")).join(lines, "k", "left").withColumn("lines", F.coalesce("lines", F.array()))
    name = lambda by, *names: F.element_at(F.array(*map(F.lit, names)), (by + 1).cast("int"))
    code = name(k % 5, "success", "failed", "fee_bump_inner_success", "fee_bump_inner_failed", "internal_error")
    inner = name(k % 3, "success", "failed", "bad_sequence")
    rows = rows.select("k", "charged", fees.operation_count(code, c("lines"), inner, F.array_append("lines", F.lit(0))).cast("long").alias("operations"))
    found = fees.fee_bucket(charged=c("charged"), operations=c("operations"), contract=F.lit(False), resource=F.lit(0))
    return rows.select("k", "operations", found["fee"].alias("fee"))


@query(
    "q84f_entries_changed",
    """select o_orderkey as k, o_orderkey % 4 as kind, case o_orderkey % 4 when 0 then o_orderkey % 11 = 0 when 1 then o_orderkey % 3 = 1 when 2 then o_orderkey % 5 = 0 else o_orderkey % 7 = 0 end as changed from orders""",
)
def q84f(t: Tables) -> DataFrame:
    """Entries of four types, before and after, that differ in form (missing fields, order of lists, counts that do not matter) and some in more."""
    k = c("k")
    pair = lambda name, a, b: F.array(*[F.struct(*[v.alias(f) for f, v in zip(name, x)]) for x in (a, b)])
    one, two = pair(("key", "weight"), (F.lit("a"), F.lit(1)), (F.lit("b"), F.lit(2))), pair(("key", "weight"), (F.lit("b"), F.lit(2)), (F.lit("a"), F.lit(1)))
    account = lambda signers, sponsors, liabilities: F.struct(k.alias("balance"), liabilities.cast("long").alias("buying_liabilities"), pr.sponsored_signers(signers, sponsors).alias("signers"))
    line = lambda liabilities, uses: F.struct(k.alias("balance"), liabilities.cast("long").alias("selling_liabilities"), uses.cast("long").alias("pool_use_count"))
    claim = lambda claimants, flags: F.struct(claimants.alias("claimants"), flags.cast("int").alias("flags"))
    fields = ("destination", "predicate")
    first, second = pair(fields, (F.lit("x"), k), (F.lit("y"), k)), pair(fields, (F.lit("y"), k), (F.lit("x"), F.when(k % 5 == 0, k + 1).otherwise(k)))
    null = F.lit(None)
    sponsors = lambda *names: F.array(*map(F.lit, names))
    accounts = (account(one, sponsors("s", "t"), null), account(two, F.when(k % 11 == 0, sponsors("s", "t")).otherwise(sponsors("t", "s")), F.lit(0)))
    lines = (line(null, F.lit(1)), line(F.when(k % 3 == 1, 5).otherwise(0), F.lit(2)))
    claims = (claim(first, null), claim(second, F.lit(0)))
    data = tuple(F.struct(v.alias("value")) for v in (k, F.when(k % 7 == 0, k + 1).otherwise(k)))
    kinds = [("account", accounts, ["balance", "buying_liabilities", "signers"]), ("trustline", lines, ["balance", "selling_liabilities", "pool_use_count"]), ("claimable_balance", claims, ["claimants", "flags"]), ("data", data, ["value"])]
    changed = F.lit(None).cast("boolean")
    for i, (kind, (pre, post), names) in enumerate(kinds):
        changed = F.when(c("kind") == i, pr.entry_changed(pre, post, names, kind)).otherwise(changed)
    return t.orders.select(c("o_orderkey").alias("k"), (c("o_orderkey") % 4).alias("kind")).select("k", "kind", changed.alias("changed"))


@query("q102_page_faults", """with o as (select o_orderkey as k, case when o_orderkey % 3 > 0 then o_orderkey end as start, case when o_orderkey % 4 = 0 then 'c' when o_orderkey % 4 = 1 then '' end as cursor, case when o_orderkey % 5 > 0 then o_orderkey % 300 end as n from orders)
select k, case when cursor = 'c' and coalesce(start, 0) <> 0 then 'start and cursor' when coalesce(cursor, '') = '' and not coalesce(start, 0) between 100 and 50000 then 'start not known' when n > 200 then 'limit too high' end as fault from o""")
def q102(t: Tables) -> DataFrame:
    """A log of requests for pages, an order each."""
    k = c("o_orderkey")
    fault = paging.page_fault(start=F.when(k % 3 > 0, k), cursor=F.when(k % 4 == 0, "c").when(k % 4 == 1, ""), limit=F.when(k % 5 > 0, k % 300), oldest=F.lit(100), latest=F.lit(50_000), max_limit=200)
    return t.orders.select(k.alias("k"), fault.alias("fault"))


@query("q102b_query_faults", """with o as (select l_orderkey as k, l_linenumber as line, l_orderkey % 6 as low, l_partkey % 6 as high, case when l_suppkey % 5 = 0 then 'c' end as cursor, case l_orderkey % 4 when 0 then 'asc' when 1 then 'desc' when 2 then '' else case when l_partkey % 9 = 0 then 'up' end end as way, case when l_partkey % 3 > 0 then l_partkey % 400 end as n, case when l_suppkey % 2 = 0 then l_suppkey * 7 % 1200 end as lim from lineitem),
f as (select *, case when lim is not null and not lim between 1 and 1000 then 'limit' when cursor is not null then case when low <> 0 or high <> 0 or coalesce(way, '') <> '' or n is not null then 'cursor and range' end
 when coalesce(way, '') not in ('', 'asc', 'desc') then 'order' when coalesce(way, '') <> 'desc' and low = 0 then 'no first ledger' when low <> 0 and high <> 0 and low > high then 'empty range' when n is not null and not n between 1 and 256 then 'filters' end as fault from o)
select coalesce(fault, 'none') as fault, count(*) as requests from f group by 1""")
def q102b(t: Tables) -> DataFrame:
    """A log of queries for events, a line each: how many are refused for what."""
    k, p, s = c("l_orderkey"), c("l_partkey"), c("l_suppkey")
    way = F.when(k % 4 == 0, "asc").when(k % 4 == 1, "desc").when(k % 4 == 2, "").when(p % 9 == 0, "up")
    fault = event_filters.query_fault(cursor=F.when(s % 5 == 0, "c"), first=k % 6, last=p % 6, order=way, n_filters=F.when(p % 3 > 0, p % 400), limit=F.when(s % 2 == 0, s * 7 % 1200))
    return t.lineitem.groupBy(F.coalesce(fault, F.lit("none")).alias("fault")).agg(F.count("*").alias("requests"))


def _history(rows: DataFrame, tag: str) -> DataFrame:
    path = scratch.shared_path(rows.sparkSession, tag)
    history.write(rows, path)
    return history.read(rows.sparkSession, path)


@query("q103_headers_at", "select c_custkey, c_custkey * 13 as ledger, o_totalprice as total from customer left join orders on o_orderkey = c_custkey * 13")
def q103(t: Tables) -> DataFrame:
    """A history of all orders as headers, looked up at a ledger a customer; some ledgers are beyond its end."""
    headers = _history(t.orders.select(c("o_orderkey").alias("sequence"), c("o_totalprice").alias("total")), "headers")
    return history.at_each(headers, t.customer.select("c_custkey", (c("c_custkey") * 13).alias("ledger")), ledger="ledger")


@query("q103b_checkpoint_transactions", "with p as (select distinct c_custkey * 640 + 63 as point from customer) select point, l_orderkey as sequence, l_linenumber as line, count(*) as n from lineitem join p on l_orderkey between point - 63 and point group by 1, 2, 3")
def q103b(t: Tables) -> DataFrame:
    """A history of all lines as transactions, and what the files of every tenth checkpoint would list."""
    txs = _history(t.lineitem.select(c("l_orderkey").alias("sequence"), c("l_linenumber").alias("line")), "transactions")
    found = history.of_checkpoints(txs, t.customer.select((c("c_custkey") * 640 + 63).alias("point")), point="point")
    return found.groupBy("point", "sequence", "line").agg(F.count("*").alias("n"))
