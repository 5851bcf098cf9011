"""Queries over contract events, contract storage and derived ids, made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions import address, contract_values as cv, derived_ids as ids
from tallyloom.functions.staged import staged
from tallyloom.operators import contract_data, contract_events, revocations
from tallyloom.plans.registry import Tables, query

c = F.col
NETWORK = "a network of tables"


def _net() -> Column:
    return ids.network_id(F.lit(NETWORK))


def _key(letter: str, number: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(letter), number.cast("string")), 256))


def _low(key: Column) -> Column:
    return F.lower(F.hex(key))


def _json(text: str, *values: Column) -> Column:
    """A JSON text with each ``%s`` replaced, as a value."""
    parts = text.split("%s")
    pieces = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        pieces += [value.cast("string"), F.lit(part)]
    return F.concat(*pieces)


ASSET_HEX = "(case when length(code) <= 4 then '00000001' || rpad(hex(code), 8, '0') else '00000002' || rpad(hex(code), 24, '0') end || '00000000' || issuer)"
CONTRACT_HEX = f"sha256(unhex('00000008' || sha256('{NETWORK}') || '00000001' || {ASSET_HEX}))"
NATIVE_HEX = f"sha256(unhex('00000008' || sha256('{NETWORK}') || '00000001' || '00000000'))"


# ---- storage


def _code(k: Column) -> Column:
    return F.when(k % 2 == 0, F.concat(F.lit("A"), k % 1000)).otherwise(F.concat(F.lit("LONGCODE"), k % 1000))


CODE = "case when k % 2 = 0 then 'A' || (k % 1000) else 'LONGCODE' || (k % 1000) end"


@query("q90_asset_rows", f"with p as (select p_partkey as k, {CODE.replace('k %', 'p_partkey %')} as code, sha256('i' || (p_partkey % 50)) as issuer from part) select k, code, issuer, {CONTRACT_HEX} as contract from p where k % 7 > 0 and k % 11 > 0 and k % 13 > 0")
def q90(t: Tables) -> DataFrame:
    """Asset descriptions in contract instances; every 7th is forged, every 11th temporary, every 13th has its fields in another order."""
    k = c("p_partkey")
    issuer = _key("i", k % 50)
    pair = F.when(k % 13 == 0, _json('{"key":{"symbol":"issuer"},"val":{"bytes":"%s"}},{"key":{"symbol":"asset_code"},"val":{"string":"%s"}}', _low(issuer), _code(k))).otherwise(_json('{"key":{"symbol":"asset_code"},"val":{"string":"%s"}},{"key":{"symbol":"issuer"},"val":{"bytes":"%s"}}', _code(k), _low(issuer)))
    value = _json('{"instance":{"executable":"stellar_asset","storage":[{"key":{"vec":[{"symbol":"Admin"}]},"val":{"void":null}},{"key":{"vec":[{"symbol":"AssetInfo"}]},"val":{"vec":[{"symbol":"%s"},{"map":[%s]}]}}]}}', F.when(k % 2 == 0, "AlphaNum4").otherwise("AlphaNum12"), pair)
    contract = F.when(k % 7 == 0, _key("x", k)).otherwise(ids.contract_id(ids.asset_bytes(_code(k), issuer), _net()))
    made = {"contract": contract, "durability": F.when(k % 11 == 0, "temporary").otherwise("persistent"), "key": cv.parsed(F.lit('{"ledger_key_contract_instance":null}')), "val": cv.parsed(value), "k": k}
    rows = staged(t.part, made)
    return contract_data.asset_rows(rows, network=_net()).select("k", "code", _low(c("issuer")).alias("issuer"), _low(c("contract")).alias("contract"))


@query("q90b_balance_rows", "select l_orderkey as o, l_linenumber as n, sha256('x' || l_partkey) as contract, sha256('h' || l_suppkey) as holder, (l_partkey::hugeint * 1000000000000000000000 + l_suppkey)::varchar as amount from lineitem where l_linenumber < 5 and l_orderkey % 5 > 0 and l_partkey % 9 > 0")
def q90b(t: Tables) -> DataFrame:
    """Balances of contracts beyond 64 bits; lines from the fifth on are held by accounts, every 5th order's are negative, every 9th part's lack a flag."""
    part, supp = c("l_partkey"), c("l_suppkey")
    by_contract = c("l_linenumber") < 5
    holder = F.coalesce(address.encode("contract", F.when(by_contract, _key("h", supp))), address.encode("account", F.when(~by_contract, _key("h", supp))))
    amount = F.concat(F.when(c("l_orderkey") % 5 == 0, "-").otherwise(""), (part.cast("decimal(38,0)") * F.expr("1000000000000000000000bd") + supp).cast("decimal(38,0)").cast("string"))
    last = F.when(part % 9 == 0, '{"u32":1}').otherwise('{"bool":false}')
    value = _json('{"map":[{"key":{"symbol":"amount"},"val":{"i128":"%s"}},{"key":{"symbol":"authorized"},"val":{"bool":true}},{"key":{"symbol":"clawback"},"val":%s}]}', amount, last)
    key = cv.parsed(_json('{"vec":[{"symbol":"Balance"},{"address":"%s"}]}', holder))
    rows = staged(t.lineitem, {"o": c("l_orderkey"), "n": c("l_linenumber"), "contract": _key("x", part), "durability": F.lit("persistent"), "key": key, "val": cv.parsed(value)})
    out = contract_data.balance_rows(rows, network=_net())
    return out.select("o", "n", _low(c("contract")).alias("contract"), _low(c("holder_key")).alias("holder"), "amount")


# ---- events


def _events(t: Tables) -> DataFrame:
    """A line is an event: version by order, kind by line number, the issuer by supplier; every third part's contract is another's."""
    o, part, supp, line = c("l_orderkey"), c("l_partkey"), c("l_suppkey"), c("l_linenumber")
    version = F.when(o % 2 == 0, 3).otherwise(4)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("transfer", "mint", "clawback", "burn", "transfer", "approve", "transfer")]), line)
    issuer = _key("i", supp % 20)
    adr = lambda key: F.concat(F.lit('{"address":"'), address.encode("account", key), F.lit('"}'))
    one, other, admin = adr(_key("s", supp)), adr(F.when(line == 5, issuer).otherwise(_key("p", part))), adr(_key("i", supp % 20))
    name = F.concat(F.lit('{"string":"'), _code(part), F.lit(":"), address.encode("account", issuer), F.lit('"}'))
    sym = F.concat(F.lit('{"symbol":"'), kind, F.lit('"}'))
    topics = F.when(kind.isin("transfer", "approve"), F.array(sym, one, other, name)).when(kind == "burn", F.array(sym, one, name)).when(version == 3, F.array(sym, admin, other, name)).otherwise(F.array(sym, other, name))
    bare = _json('{"i128":"%s"}', part * 1000 + line)
    marked = _json('{"map":[{"key":{"symbol":"amount"},"val":{"i128":"%s"}},{"key":{"symbol":"to_muxed_id"},"val":{"u64":"%s"}}]}', part * 1000 + line, supp)
    contract = F.when(part % 3 == 0, _key("x", part)).otherwise(ids.contract_id(ids.asset_bytes(_code(part), issuer), _net()))
    data = F.when(line == 7, marked).otherwise(bare)
    given = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    made = {"ledger": o, "tx_index": line, "op_index": F.lit(0), "meta_version": version, "type": F.lit("contract"), "contract": contract, "body_version": F.lit(0), "topics": F.transform(topics, cv.parsed), "data": cv.parsed(data)}
    return staged(given, made).select(*made)


EVENT_SQL = f"""e as (select l_orderkey as ledger, l_linenumber as tx_index, l_orderkey % 2 = 0 as old, l_partkey as part, l_partkey as k, l_suppkey as supp, l_partkey % 3 > 0 as proven,
  ['transfer', 'mint', 'clawback', 'burn', 'transfer', 'approve', 'transfer'][l_linenumber] as kind, {CODE.replace("k %", "l_partkey %")} as code, sha256('i' || (l_suppkey % 20)) as issuer,
  sha256('s' || l_suppkey) as one, case when l_linenumber = 5 then sha256('i' || (l_suppkey % 20)) else sha256('p' || l_partkey) end as other from lineitem)"""


@query(
    "q91_token_events",
    f"""with {EVENT_SQL}
select ledger, tx_index, case when kind = 'transfer' and old and proven and other = issuer then 'burn' else kind end as kind,
  case kind when 'transfer' then one when 'clawback' then other when 'burn' then one end as source,
  case when kind = 'transfer' and not (old and proven and other = issuer) or kind = 'mint' then other end as target,
  (part * 1000 + tx_index)::varchar as amount, case when proven then code end as code, case when proven then issuer end as issuer,
  case when tx_index = 7 then 'id' end as mark_kind, case when tx_index = 7 then supp::varchar end as mark
from e where kind <> 'approve' and not (old and tx_index = 7)""",
)
def q91(t: Tables) -> DataFrame:
    """Events of both versions as token movements; in the older one transfers to the issuer are burns and data are no maps."""
    rows = contract_events.token_movements(_events(t), network=_net())
    key = lambda who: _low(address.decode(c(who))["key"])
    issuer = _low(address.decode(F.substring_index("asset", ":", -1))["key"])
    return rows.select("ledger", "tx_index", "kind", key("source").alias("source"), key("target").alias("target"), "amount", F.substring_index("asset", ":", 1).alias("code"), issuer.alias("issuer"), c("mark.kind").alias("mark_kind"), c("mark.value").alias("mark"))


@query("q91b_events_dropped", f"with {EVENT_SQL} select ledger, tx_index, case when kind = 'approve' then 'other name' else 'amount' end as wrong from e where kind = 'approve' or old and tx_index = 7")
def q91b(t: Tables) -> DataFrame:
    """What is no token movement, and why."""
    return contract_events.read_events(_events(t), network=_net()).where("wrong is not null").select("ledger", "tx_index", "wrong")


@query(
    "q91c_asset_contract_events",
    f"""with {EVENT_SQL},
v as (select *, case when kind = 'approve' then 'not an asset contract' when not proven then 'integrity' when not old and kind in ('mint', 'clawback') then 'invalid' else 'ok' end as verdict from e)
select ledger, tx_index, verdict, case when verdict = 'ok' then kind end as kind, case when verdict = 'ok' then case when kind in ('mint', 'clawback') then issuer else one end end as first,
  case when verdict = 'ok' and kind <> 'burn' then other end as second, case when verdict = 'ok' then (part * 1000 + tx_index)::varchar end as amount, case when verdict = 'ok' then code end as code from v""",
)
def q91c(t: Tables) -> DataFrame:
    """The stricter reading: events of standard asset contracts, refused where the contract is not the asset's."""
    rows = contract_events.asset_events(_events(t), network=_net())
    key = lambda who: _low(address.decode(c(who))["key"])
    return rows.select("ledger", "tx_index", "verdict", "kind", key("first").alias("first"), key("second").alias("second"), "amount", F.substring_index("asset", ":", 1).alias("code"))


FEE_SQL = """with o as (select o_orderkey as ledger, o_custkey as cust, case when o_orderkey % 17 = 0 then 3 when o_orderkey % 3 = 0 then 2 else 1 end as n, o_orderkey % 13 = 0 as foreign_ from orders)
select ledger, 1 as tx_index, sha256('c' || cust) as source, (case when i = 0 then cust * 100 else -i end)::varchar as amount, null as wrong from o, range(3) r(i) where i < n and n < 3 and not foreign_
union all select ledger, 1, null, null, case when foreign_ then 'contract' else 'too many fees' end from o where n = 3 or foreign_"""


@query("q91d_fee_events", FEE_SQL)
def q91d(t: Tables) -> DataFrame:
    """Fees and refunds as events; every 17th order has three, every 13th comes from another contract."""
    o = c("o_orderkey")
    n = F.when(o % 17 == 0, 3).when(o % 3 == 0, 2).otherwise(1)
    nothing = F.lit(None)
    contract = F.when(o % 13 == 0, _key("x", o)).otherwise(ids.contract_id(ids.asset_bytes(nothing.cast("string"), nothing.cast("binary")), _net()))
    rows = t.orders.select(o.alias("ledger"), F.lit(1).alias("tx_index"), "o_custkey", contract.alias("contract"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    amount = F.when(c("i") == 0, c("o_custkey") * 100).otherwise(-c("i"))
    topics = F.array(F.lit('{"symbol":"fee"}'), F.concat(F.lit('{"address":"'), address.encode("account", _key("c", c("o_custkey"))), F.lit('"}')))
    rows = staged(rows, {"type": F.lit("contract"), "body_version": F.lit(0), "topics": F.transform(topics, cv.parsed), "data": cv.parsed(_json('{"i128":"%s"}', amount))})
    out = contract_events.fee_events(rows, network=_net(), on_error="mark")
    return out.select("ledger", "tx_index", _low(address.decode(c("source"))["key"]).alias("source"), "amount", "wrong")


# ---- values and ids


@query(
    "q92_nested_values",
    """with e as (select event_id, event_type as y, user_id as u, json_extract_string(props, '$.k') as k from events)
select event_id, '[' || y || ' {' || case when event_id % 2 = 0 then y || ' ' || k || '} {u ' || u else 'u ' || u || '} {' || y || ' ' || k end || '}] (void)]' as text, event_id % 2 = 0 as same from e""".replace("'[' || y || ' {'", "'[' || y || ' [{'"),
)
def q92(t: Tables) -> DataFrame:
    """Values of three levels as text, and whether they equal one whose map is in the first order."""
    k = F.get_json_object("props", "$.k")
    first, second = _json('{"key":{"symbol":"%s"},"val":{"i128":"%s"}}', c("event_type"), k), _json('{"key":{"symbol":"u"},"val":{"u64":"%s"}}', c("user_id"))
    whole = lambda a, b: cv.parsed(_json('{"vec":[{"string":"%s"},{"map":[%s,%s]},{"void":null}]}', c("event_type"), a, b))
    even = c("event_id") % 2 == 0
    rows = t.events.select("event_id", whole(F.when(even, first).otherwise(second), F.when(even, second).otherwise(first)).alias("v"), whole(first, second).alias("w"))
    return rows.select("event_id", cv.rendered(c("v")).alias("text"), cv.same(c("v"), c("w")).alias("same"))


POOL_SQL = f"""p as (select p_partkey as k, {CODE.replace("k %", "p_partkey %")} as code, sha256('i' || (p_partkey % 50)) as issuer from part),
h as (select k, {ASSET_HEX} as asset, {CONTRACT_HEX} as contract from p),
n as (select k, asset, contract, sha256(unhex('00000000' || '00000000' || asset || printf('%08x', (k % 100)::int))) as pool from h)"""


@query("q93_derived_ids", f"with {POOL_SQL} select k, contract, pool, sha256(unhex('00000007' || '00000000' || sha256('c' || k) || printf('%016x', k * 5000000000) || printf('%08x', (k % 7)::int) || pool || asset)) as balance from n")
def q93(t: Tables) -> DataFrame:
    """Contracts of assets, pools of each asset with the native one, and the balances that revocations make of them."""
    k = c("p_partkey")
    nothing = F.lit(None)
    native = ids.asset_bytes(nothing.cast("string"), nothing.cast("binary"))
    rows = t.part.select(k.alias("k"), ids.asset_bytes(_code(k), _key("i", k % 50)).alias("asset"))
    rows = rows.withColumn("pool", ids.pool_id(native, c("asset"), c("k") % 100))
    balance = ids.revoked_balance_id(account=_key("c", c("k")), sequence=c("k") * 5_000_000_000, op_index=c("k") % 7, pool=c("pool"), asset=c("asset"))
    return rows.select("k", _low(ids.contract_id(c("asset"), _net())).alias("contract"), _low(c("pool")).alias("pool"), _low(balance).alias("balance"))


@query(
    "q94_revoked_trust_lines",
    """with l as (select l_orderkey as ledger, l_linenumber as op_index, sha256('P' || l_partkey) as pool, '00000000' as a, '00000001' || '41' || '000000' || '00000000' || sha256('i' || l_suppkey) as b,
  l_partkey as la, l_suppkey as lb, (l_orderkey + l_linenumber) % 4 as arm, sha256('s' || l_orderkey) as account from (select l_orderkey, l_linenumber, l_partkey, min(l_suppkey) as l_suppkey from lineitem group by all)),
i as (select *, sha256(unhex('00000007' || '00000000' || account || printf('%016x', ledger) || printf('%08x', op_index::int) || pool || a)) as ia, sha256(unhex('00000007' || '00000000' || account || printf('%016x', ledger) || printf('%08x', op_index::int) || pool || b)) as ib from l)
select ledger, 1 as tx_index, op_index, pool, 0 as leg, 'transfer' as kind, case when arm = 2 then ib else ia end as target, case when arm = 2 then b else a end as asset, case when arm = 2 then lb else la end as amount from i where arm > 0
union all select ledger, 1, op_index, pool, 1, case when arm = 3 then 'transfer' else 'burn' end, case when arm = 3 then ib end, case when arm = 2 then a else b end, case when arm = 2 then la else lb end from i where arm > 0""",
)
def q94(t: Tables) -> DataFrame:
    """Pools that lost shares, with none, one (either) or both of the balances created.

    Lines and orders are dealt by ledger as the few numbers that they are; the digests, which make a line some 40 times as wide,
    are made where they are used. So there are as many tasks as the lines read ask for, not as few as their moved bytes do.
    """
    o, line = c("l_orderkey"), c("l_linenumber")
    nothing = F.lit(None)
    a, b = ids.asset_bytes(nothing.cast("string"), nothing.cast("binary")), ids.asset_bytes(F.lit("A"), _key("i", c("l_suppkey")))
    tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), 16 * t.lineitem.rdd.getNumPartitions())
    lines = t.lineitem.select(o, line, "l_partkey", "l_suppkey").repartition(tasks, o).groupBy(o, line, "l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    pools = lines.select(o.alias("ledger"), F.lit(1).alias("tx_index"), line.alias("op_index"), _key("P", c("l_partkey")).alias("pool"), a.alias("asset_a"), b.alias("asset_b"), (-c("l_partkey")).alias("amount_a"), c("l_suppkey").alias("amount_b"))
    txs = t.orders.select("o_orderkey").repartition(tasks, "o_orderkey").select(c("o_orderkey").alias("ledger"), F.lit(1).alias("tx_index"), _key("s", c("o_orderkey")).alias("account"), c("o_orderkey").alias("sequence"))
    arm = (c("ledger") + c("op_index")) % 4
    made = pools.withColumn("side", F.explode(F.array_compact(F.array(F.when(arm.isin(1, 3), F.lit("a")), F.when(arm.isin(2, 3), F.lit("b"))))))
    asset, amount = F.when(c("side") == "a", c("asset_a")).otherwise(c("asset_b")), F.abs(F.when(c("side") == "a", c("amount_a")).otherwise(c("amount_b")))
    created = made.select("ledger", "tx_index", "op_index", ids.revoked_balance_id(account=_key("s", c("ledger")), sequence=c("ledger"), op_index=c("op_index"), pool=c("pool"), asset=asset).alias("balance_id"), asset.alias("asset"), amount.alias("amount"))
    out = revocations.revocation_movements(pools, created, txs)
    return out.select("ledger", "tx_index", "op_index", _low(c("pool")).alias("pool"), "leg", "kind", _low(c("target")).alias("target"), _low(c("asset")).alias("asset"), "amount")
