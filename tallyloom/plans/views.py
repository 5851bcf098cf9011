"""The star-schema tables seen as ledger data: the same columns in DataFrames and in SQL.

A ledger is an order (or a day), an operation a line of it, an asset a part, an account a customer or a supplier, a keyed
change an event of a user. Money is whole cents, so that sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.timing import epoch_ms
from tallyloom.plans.registry import Tables


def cents(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 100).cast("long")


def trades(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("ledger"), F.col("l_linenumber").alias("line"), epoch_ms(F.col("l_shipdate")).alias("ms"), F.round("l_quantity").cast("long").alias("base"), cents("l_extendedprice").alias("counter"))


TRADES = "tr as (select l_partkey part, l_suppkey supp, l_orderkey ledger, l_linenumber line, (epoch_us(l_shipdate) // 1000) ms, cast(round(l_quantity) as bigint) base, cast(round(l_extendedprice * 100) as bigint) counter from lineitem)"


def changes(t: Tables) -> DataFrame:
    """Events of users as changes by day: signup creates, error removes, all else updates; the value is in cents."""
    kind = F.when(F.col("event_type") == "signup", F.lit("created")).when(F.col("event_type") == "error", F.lit("removed")).otherwise(F.lit("updated"))
    return t.events.select("event_id", "user_id", F.to_date("ts").alias("day"), epoch_ms(F.col("ts")).alias("ms"), kind.alias("kind"), cents("value").alias("value"))


CHANGES = "ch as (select event_id, user_id, cast(ts as date) as day, (epoch_us(ts) // 1000) ms, case event_type when 'signup' then 'created' when 'error' then 'removed' else 'updated' end as kind, cast(round(value * 100) as bigint) as value from events)"


def op_ids(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("ledger"), F.col("l_linenumber").cast("long").alias("tx"), F.pmod(F.col("l_partkey"), F.lit(4096)).alias("op"), F.col("l_suppkey").alias("supp"))


OP_IDS = "oi as (select l_orderkey as ledger, cast(l_linenumber as bigint) as tx, l_partkey % 4096 as op, l_suppkey as supp from lineitem)"
POS = "(ledger * 4294967296 + tx * 4096 + op)"


def offers(t: Tables) -> DataFrame:
    """Lines as offers of 40 assets for each other."""
    return t.lineitem.where("l_partkey % 40 <> l_suppkey % 40").select(F.concat(F.lit("a"), F.col("l_partkey") % 40).alias("selling"), F.concat(F.lit("a"), F.col("l_suppkey") % 40).alias("buying"), F.col("l_quantity").cast("long").alias("amount"), (1 + F.col("l_linenumber")).cast("long").alias("n"), (1 + F.col("l_orderkey") % 5).alias("d"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offer_id"))


LEVELS = """o as (select 'a' || (l_partkey % 40) as selling, 'a' || (l_suppkey % 40) as buying, cast(l_quantity as bigint) as amount, cast(1 + l_linenumber as bigint) as n, 1 + l_orderkey % 5 as d, l_orderkey * 10 + l_linenumber as offer_id from lineitem where l_partkey % 40 <> l_suppkey % 40 and cast(l_quantity as bigint) > 0),
k as (select *, (amount * n + d - 1) // d as cost from o),
lv as (select *, coalesce(sum(amount) over w, 0)::bigint as ab, coalesce(sum(cost) over w, 0)::bigint as cb from k window w as (partition by selling, buying order by cast(n as decimal(38, 18)) / d, offer_id, amount rows between unbounded preceding and 1 preceding))"""
