"""Queries over digests of archives and replays, made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions import ids
from tallyloom.operators import changes as ch, hash_trees as ht
from tallyloom.plans import views
from tallyloom.plans.registry import Tables, query
from tallyloom.plans.views import CHANGES
from tallyloom.sinks import objects, scratch
from tallyloom.sources import lake
from tallyloom.streaming import book_stream, ledger_stream

c = F.col


def _digest(*parts) -> Column:
    return F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def _envelopes(t: Tables) -> DataFrame:
    return t.lineitem.select(c("l_orderkey").alias("sequence"), F.encode(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"), "UTF-8").alias("body"))


def _headers(t: Tables) -> DataFrame:
    """Every 101st header has a byte of its content changed, every 103rd names another set, every 107th another result set."""
    k = c("o_orderkey")
    content = F.concat(F.lit("header "), k.cast("string"))
    previous = _digest("header ", k - 1)
    lines = t.lineitem.groupBy(c("l_orderkey").alias("__of")).agg(F.array_sort(F.collect_list(F.struct(F.unhex(F.sha2(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"), 256)).alias("own"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("body")))).alias("txs"))
    rows = t.orders.join(lines, k == c("__of"), "left")
    joined = F.concat(F.unhex(previous), F.encode(F.coalesce(F.array_join(F.transform("txs", lambda x: x["body"]), ""), F.lit("")), "UTF-8"))
    named_set = F.when(k % 103 == 0, _digest("x", k)).otherwise(F.sha2(joined, 256))
    named_result = F.when(k % 107 == 0, _digest("y", k)).when(k % 10 == 0, F.lit(ht.EMPTY_RESULTS)).otherwise(_digest("result ", k))
    return rows.select(k.alias("sequence"), F.encode(F.when(k % 101 == 0, F.concat(content, F.lit("?"))).otherwise(content), "UTF-8").alias("content"), _digest("header ", k).alias("hash"), previous.alias("prev_hash"), named_set.alias("set_hash"), named_result.alias("result_hash"))


SETS = """e as (select l_orderkey as k, concat_ws('-', l_orderkey, l_linenumber, l_partkey) as body from lineitem),
s as (select k, sha256(unhex(sha256('header ' || (k - 1)) || string_agg(hex(body), '' order by sha256(body)))) as hash from e where k in (select o_orderkey from orders) group by k)"""


@query("q95_set_hashes", f"with {SETS} select k as sequence, hash from s")
def q95(t: Tables) -> DataFrame:
    """Digests of transaction sets, sorted by the envelopes' own digests."""
    headers = t.orders.select(c("o_orderkey").alias("sequence"), _digest("header ", c("o_orderkey") - 1).alias("prev_hash"))
    return ht.set_hashes(_envelopes(t), headers)


@query(
    "q95b_hash_report",
    f"""with {SETS}, h as (select o_orderkey as k from orders), f as (select min(k) as first from h)
select 'header content' as what, k as sequence, sha256('header ' || k) as expected, sha256('header ' || k || '?') as actual from h where k % 101 = 0
union all select 'ledger header', k - 1, sha256('header ' || (k - 1)), case when k - 1 in (select k from h) then sha256('header ' || (k - 1) || '?') end from h, f where k > first and ((k - 1) % 101 = 0 or k - 1 not in (select k from h))
union all select 'transaction set', h.k, sha256('x' || h.k), hash from h left join s using (k) where h.k % 103 = 0
union all select 'result set', k, case when k % 107 = 0 then sha256('y' || k) else sha256('result ' || k) end, case when k % 5 > 0 and k % 10 > 0 then sha256('result ' || k) end from h where k % 107 = 0 or k % 10 = 5""",
)
def q95b(t: Tables) -> DataFrame:
    """Changed bytes, wrong names and missing result sets; those without entries are not missed."""
    k = c("o_orderkey")
    results = t.orders.where(k % 5 > 0).select(k.alias("sequence"), _digest("result ", k).alias("hash"))
    headers = _headers(t)
    return ht.hash_report(headers, ht.set_hashes(_envelopes(t), headers), results)


LEVELS_OF = "[{'curr': case when (k + i) % 7 > 0 then sha256('curr ' || k || '-' || i) else '' end, 'snap': case when (k + i) % 5 > 0 then sha256('snap ' || k || '-' || i) else '' end} for i in range(11)]"


@query("q95c_bucket_list_hashes", f"with u as (select c_custkey as k from customer), l as (select k, {LEVELS_OF} as levels from u) select k as sequence, sha256(unhex(array_to_string([sha256(unhex(x.curr || x.snap)) for x in levels], ''))) as hash from l")
def q95c(t: Tables) -> DataFrame:
    return _states(t).select("sequence", ht.bucket_list_hash(c("levels")).alias("hash"))


def _states(t: Tables) -> DataFrame:
    """The states of all customers. Keys are dealt first, as bytes of a state are many and a file of keys is small: it would be read, and digested, by one task."""
    rows = t.customer.select(c("c_custkey").alias("sequence"))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sequence")
    k = c("sequence")
    part = lambda name, i, m: F.when((k + i) % m > 0, _digest(f"{name} ", k, "-", F.lit(i))).otherwise("")
    levels = F.array(*[F.struct(part("curr", i, 7).alias("curr"), part("snap", i, 5).alias("snap")) for i in range(11)])
    return rows.select("sequence", levels.alias("levels"))


@query("q95d_bucket_lists_not_as_named", f"with u as (select c_custkey as k from customer where c_custkey % 13 = 0 or c_custkey % 17 = 0), l as (select k, {LEVELS_OF} as levels from u) select k as sequence, case when k % 17 > 0 then sha256('other') end as expected, sha256(unhex(array_to_string([sha256(unhex(x.curr || x.snap)) for x in levels], ''))) as actual from l")
def q95d(t: Tables) -> DataFrame:
    """Headers name the lists of their states, but every 13th names another and every 17th is not there."""
    k = c("sequence")
    headers = _states(t).where(k % 17 > 0).select("sequence", F.when(k % 13 == 0, F.sha2(F.lit("other"), 256)).otherwise(ht.bucket_list_hash(c("levels"))).alias("bucket_list_hash"))
    return ht.list_hash_report(_states(t), headers)


@query("q95e_bucket_contents", "with p as (select distinct l_partkey as k from lineitem) select sha256('bucket ' || k) as hash, case when k not in (select p_partkey from part) or k % 19 = 0 then 'missing' when k % 23 = 0 then 'invalid' else 'ok' end as verdict from p")
def q95e(t: Tables) -> DataFrame:
    """Lines refer to the buckets of their parts; every 19th is missing, every 23rd has a byte more."""
    k = c("p_partkey")
    content = F.concat(F.lit("bucket "), k.cast("string"), F.when(k % 23 == 0, "?").otherwise(""))
    buckets = t.part.where(k % 19 > 0).select(_digest("bucket ", k).alias("hash"), F.encode(content, "UTF-8").alias("content"))
    return ht.bucket_report(t.lineitem.select(_digest("bucket ", c("l_partkey")).alias("hash")), buckets)


@query(
    "q96_unknown_keys",
    f"""with {CHANGES}, o as (select *, lag(kind) over (partition by user_id order by ms, event_id) as last from ch)
select event_id, user_id from o where kind <> 'created' and (last = 'removed' or last is null and user_id % 3 > 0)""",
)
def q96(t: Tables) -> DataFrame:
    """Changes to users who are not there: the snapshot has every third, and errors take users away."""
    kind, value = c("kind"), c("value")
    rows = views.changes(t).select("event_id", "user_id", "ms", F.when(kind != "created", value).alias("pre"), F.when(kind != "removed", value).alias("post"))
    snapshot = t.events.where(c("user_id") % 3 == 0).select("user_id")
    return ch.unknown_keys(rows, snapshot, key="user_id", order=["ms", "event_id"]).select("event_id", "user_id")


BOOK_SQL = """with o as (select o_orderkey as ledger, o_custkey as id, 'a' || (o_custkey % 7) as selling, 'a' || (o_custkey % 5 + 7) as buying, o_custkey % 11 = 0 as pool, o_orderkey % 4 = 0 as removed,
  1 + o_orderkey % 1000 as amount, 1 + o_orderkey % 3 as n, 1 + o_orderkey % 2 as d from orders),
l as (select *, row_number() over (partition by pool, case when pool then selling || buying else id::varchar end order by ledger desc) as k from o)
select selling, buying, n // gcd(n, d) as n, d // gcd(n, d) as d, count(*) as offers, sum(amount)::bigint as amount, null::bigint as reserve_a, null::bigint as reserve_b from l where k = 1 and not removed and not pool group by 1, 2, 3, 4
union all select selling, buying, null, null, null, null, amount, ledger from l where k = 1 and not removed and pool"""


@query("q97_book_state", BOOK_SQL)
def q97(t: Tables) -> DataFrame:
    """The book that a stream of all orders leaves in its state: what each price holds, and pools; every 4th order removes."""
    k, cust = c("o_orderkey"), c("o_custkey")
    stream = ledger_stream.file_stream(t.spark, f"{t.folder}/orders.parquet")
    is_pool = cust % 11 == 0
    amount = 1 + k % 1000
    rows = stream.select(k.alias("ledger"), F.lit(0).alias("place"), F.when(is_pool, "pool").otherwise("offer").alias("what"), (k % 4 == 0).alias("removed"), F.concat(F.lit("a"), cust % 7).alias("selling"), F.concat(F.lit("a"), cust % 5 + 7).alias("buying"), cust.alias("id"), amount.alias("amount"), (1 + k % 3).alias("n"), (1 + k % 2).alias("d"), amount.alias("reserve_a"), k.alias("reserve_b"))
    checkpoint = scratch.shared_path(t.spark, "book")
    book_stream.run_book(rows, path=scratch.shared_path(t.spark, "stream"), checkpoint=checkpoint)
    empty = [F.lit(None).cast("long").alias(n) for n in ("reserve_a", "reserve_b")]
    levels = book_stream.book_levels(t.spark, checkpoint).select("selling", "buying", "n", "d", "offers", c("amount").cast("long").alias("amount"), *empty)
    pools = book_stream.book_pools(t.spark, checkpoint)
    return levels.unionByName(pools, allowMissingColumns=True)


@query(
    "q99_mirror",
    """with p as (select o_orderkey // 64 * 64 + 63 as chk, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as body from orders group by 1),
h as (select *, printf('%08x', chk) as x from p)
select 'ledger/' || x[1:2] || '/' || x[3:4] || '/' || x[5:6] || '/ledger-' || x || '.xdr.gz' as path, chk % 128 = 63 as was_there, sha256(case when chk % 128 = 63 then 'old' else body end) as hash from h""",
)
def q99(t: Tables) -> DataFrame:
    """An archive of all orders and a copy that has every second file, of other content: what is missing is copied, what is there stays."""
    point = F.floor(c("o_orderkey") / 64).cast("long") * 64 + 63
    files = t.orders.groupBy(point.alias("chk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("body"))
    files = files.select("chk", ids.category_path(F.lit("ledger"), c("chk")).alias("path"), F.encode("body", "UTF-8").alias("content"))
    source, target = scratch.shared_path(t.spark, "archive"), scratch.shared_path(t.spark, "mirror")
    objects.put_if_absent(files, source).write.format("noop").mode("overwrite").save()
    half = files.where("chk % 128 = 63").select("path", F.encode(F.lit("old"), "UTF-8").alias("content"))
    objects.put_if_absent(half, target).write.format("noop").mode("overwrite").save()
    copied = scratch.written(objects.mirrored(t.spark, source, target).where("created"), "copied")
    held = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target)
    there = objects.relative(held.select("path", F.sha2("content", 256).alias("hash")), target).join(objects.relative(lake.listing(t.spark, target), target), "path")
    return there.join(copied.select("path", F.lit(False).alias("fresh")), "path", "left").select("path", c("fresh").isNull().alias("was_there"), "hash")
