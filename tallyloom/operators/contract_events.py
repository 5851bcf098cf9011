"""Contract events read as token movements: topic layouts by version, amounts and marks in the data, assets proven by derived ids.

Events are rows of (ledger, tx_index, op_index, meta_version, type, contract: binary, body_version, topics: array<variant>, data:
variant); other columns pass through. All is row by row (addresses aside, by built-in functions): an asset's contract id is derived from its name
where it is claimed, so there is no dimension to join and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions import address, contract_values as cv, derived_ids as ids
from tallyloom.functions.staged import staged

KINDS = ("transfer", "mint", "clawback", "burn")
#: Places of the addresses by meta version and kind, and the number of topics with an asset's name at the end. Fixed values.
LAYOUTS = {
    (3, "transfer"): ({"source": 1, "target": 2}, 4),
    (3, "mint"): ({"admin": 1, "target": 2}, 4),
    (3, "clawback"): ({"admin": 1, "source": 2}, 4),
    (3, "burn"): ({"source": 1}, 3),
    (4, "transfer"): ({"source": 1, "target": 2}, 4),
    (4, "mint"): ({"target": 1}, 3),
    (4, "clawback"): ({"source": 1}, 3),
    (4, "burn"): ({"source": 1}, 3),
}
_MARK = "struct<kind:string,value:string>"


def _topic(i: int) -> Column:
    return F.get("topics", F.lit(i))


def _is_contract_event() -> Column:
    return (F.col("type") == "contract") & F.col("contract").isNotNull() & (F.col("body_version") == 0)


def event_data(data: Column, pairs: Column | None = None) -> Column:
    """What newer data say: a struct of ``amount`` (decimal text), ``mark`` (kind and value) and ``wrong``, a reason or null.

    Data are a 128-bit amount, or a map of symbols with such an ``amount`` and perhaps a ``to_muxed_id``: a number, bytes (of
    any length, in hex), a text or nothing. Other keys mean nothing; a key that is no symbol spoils the map. ``pairs`` are its
    ``entries``, if they are a column already.
    """
    pairs = cv.entries(data) if pairs is None else pairs
    value = lambda name: F.try_element_at(F.filter(pairs, lambda e: cv.text_of(e["key"], "symbol") == name), F.lit(-1))["val"]
    there = lambda name: F.exists(pairs, lambda e: cv.text_of(e["key"], "symbol") == name)
    named = F.forall(pairs, lambda e: cv.has(e["key"], "symbol"))
    muxed = value("to_muxed_id")
    mark = F.coalesce(*[F.when(cv.has(muxed, kind), F.struct(F.lit(says).alias("kind"), cv.text_of(muxed, kind).alias("value"))) for kind, says in (("u64", "id"), ("bytes", "hash"), ("string", "text"))])
    fine_mark = ~there("to_muxed_id") | mark.isNotNull() | cv.has(muxed, "void")
    amounts = F.forall(F.filter(pairs, lambda e: cv.text_of(e["key"], "symbol") == "amount"), lambda e: cv.whole(e["val"]).isNotNull())
    is_map = cv.has(data, "map")
    wrong = (
        F.when(~is_map, F.when(cv.whole(data).isNull(), "amount"))
        .when(pairs.isNull(), "map is empty")
        .when(~named, "key type")
        .when(~amounts, "amount")
        .when(~fine_mark, "to_muxed_id")
        .when(~there("amount"), "no amount")
    )
    amount = F.when(is_map, cv.whole(value("amount"))).otherwise(cv.whole(data))
    return F.struct(amount.alias("amount"), F.when(is_map, mark).cast(_MARK).alias("mark"), wrong.alias("wrong"))


def plain_data(whole: Column) -> Column:
    """What data that are no map say, by their number (``whole``)."""
    return F.struct(whole.alias("amount"), F.lit(None).cast(_MARK).alias("mark"), F.when(whole.isNull(), "amount").alias("wrong"))


def claimed_asset(text: Column) -> Column:
    """``native`` (in any case) or ``code:issuer`` as a struct (native, code, issuer: key); null for other text and for addresses that are none."""
    bits = F.split(text, ":")
    key = address.once(address.decode(F.get(bits, F.lit(1))), lambda d: F.when(d["kind"] == "account", d["key"]))
    issued = F.when((F.size(bits) == 2) & bits[0].rlike("^[a-zA-Z0-9]{1,12}$") & key.isNotNull(), F.struct(F.lit(False).alias("native"), bits[0].alias("code"), key.alias("issuer")))
    native = F.struct(F.lit(True).alias("native"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("binary").alias("issuer"))
    return F.when(F.lower(text) == "native", native).otherwise(issued)


def _proven(asset: Column, network: Column) -> Column:
    return F.coalesce(F.col("contract") == ids.contract_id(ids.asset_bytes(asset["code"], asset["issuer"]), network), F.lit(False))


def read_events(events: DataFrame, *, network: Column) -> DataFrame:
    """``events`` with ``wrong`` (why it is no token movement, null if it is one), ``kind``, ``source``, ``target``, ``amount``, ``asset`` and ``mark``.

    Version 3 and 4 events are laid out by ``LAYOUTS``; more topics than needed are allowed. An asset is named only if the
    topics are as many as a standard contract writes, the last is an asset's name and the event's contract is the one
    derived from it; other events are movements of some token, with a null ``asset``. In version 3 such contracts write
    mints and burns as transfers: a transfer from (to) the issuer is a mint (burn), both ways a transfer, and muxed
    addresses become their accounts. Only version 4 data have a ``mark``. Amounts are decimal texts of up to 128 bits.
    Null topics, data or contract: wrong.
    """
    c = F.col
    version, n = c("meta_version"), F.size("topics")
    rows = events.withColumn("kind", cv.text_of(_topic(0), "symbol"))
    layout = lambda what, default: F.coalesce(*[F.when((version == v) & (c("kind") == k), F.lit(what(places, size))) for (v, k), (places, size) in LAYOUTS.items()], F.lit(default))
    texts = {f"__{who}": F.when(layout(lambda p, _, who=who: p.get(who, 0), 0) > 0, cv.text_of(F.get("topics", layout(lambda p, _, who=who: p.get(who, 0), 0)), "address")) for who in ("source", "target", "admin")}
    name = F.when(n == layout(lambda _, size: size, 0), cv.text_of(F.try_element_at("topics", F.lit(-1)), "string"))
    rows = staged(rows, texts | {"kind": c("kind"), "__name": name, "__whole": cv.whole(c("data")), "__pairs": F.when(version == 4, cv.entries(c("data")))})
    # Addresses are read in one pass over all of a row, and what else is needed of them comes from there or from the text
    read = {f"__{who}": F.struct(c(f"__{who}").alias("text"), address.decode(c(f"__{who}")).alias("d")) for who in ("source", "target", "admin")}
    data = F.when(version == 4, F.when(cv.has(c("data"), "map"), event_data(c("data"), c("__pairs"))).otherwise(plain_data(c("__whole")))).otherwise(plain_data(c("__whole")))
    rows = staged(rows, read | {"__data": data, "__asset": claimed_asset(c("__name"))})
    for who in ("source", "target", "admin"):
        rows = rows.withColumn(f"__{who}_kind", c(f"__{who}.d.kind"))
    least = layout(lambda p, _: 1 + max(p.values()), 99)
    missing = lambda who: (layout(lambda p, _: p.get(who, 0), 0) > 0) & c(f"__{who}_kind").isNull()
    wrong = (
        F.when(~F.coalesce(_is_contract_event(), F.lit(False)), "no contract event")
        .when(~F.coalesce(n >= 2, F.lit(False)), "too few topics")
        .when(c("kind").isNull(), "no name")
        .when(~version.isin(3, 4), "meta version")
        .when(c("__data.wrong").isNotNull(), c("__data.wrong"))
        .when(~c("kind").isin(*KINDS), "other name")
        .when(n < least, "too few topics")
        .when(missing("source") | missing("target") | missing("admin"), "address")
    )
    proven = F.when(wrong.isNull() & c("__asset").isNotNull(), _proven(c("__asset"), network)).otherwise(F.lit(False))
    rows = staged(rows, {"wrong": wrong, "__proven": proven})
    issuer = F.when(c("__proven") & ~c("__asset.native"), F.get(F.split("__name", ":"), F.lit(1)))  # the one text of its key
    asset = F.when(c("__proven"), F.when(c("__asset.native"), "native").otherwise(F.concat(c("__asset.code"), F.lit(":"), c("__issuer"))))
    rows = rows.withColumn("__issuer", issuer).withColumn("asset", asset)
    behind = lambda who: (c("__proven") & (version == 3) & (c("kind") == "transfer") & (c(f"__{who}_kind") == "muxed"))
    account = lambda who: address.encode("account", F.when(behind(who) & (F.octet_length(c(f"__{who}.d.key")) == 40), F.substring(c(f"__{who}.d.key"), 1, 32)))
    rows = staged(rows, {who: F.when(behind(who), account(who)).otherwise(c(f"__{who}.text")) for who in ("source", "target")})
    fixes = c("__proven") & (version == 3) & (c("kind") == "transfer")
    out, into = F.coalesce(c("source") == c("__issuer"), F.lit(False)), F.coalesce(c("target") == c("__issuer"), F.lit(False))
    kind = F.when(fixes & out & ~into, "mint").when(fixes & into & ~out, "burn").otherwise(c("kind"))
    fine = c("wrong").isNull()
    found = {
        "source": F.when(fine & (kind != "mint"), c("source")),
        "target": F.when(fine & kind.isin("transfer", "mint"), c("target")),
        "amount": F.when(fine, c("__data.amount")),
        "mark": F.when(fine, c("__data.mark")),
        "asset": F.when(fine, c("asset")),
        "kind": F.when(fine, kind),
    }
    rows = rows.withColumns(found)
    return rows.drop(*[x for x in rows.columns if x.startswith("__")])


def token_movements(events: DataFrame, *, network: Column) -> DataFrame:
    """The events that are token movements (see ``read_events``); what does not fit is dropped without an error."""
    return read_events(events, network=network).where("wrong is null").drop("wrong")


def asset_events(events: DataFrame, *, network: Column) -> DataFrame:
    """``events`` as those of a standard asset contract: ``verdict``, ``kind``, ``first``, ``second``, ``amount`` and ``asset``.

    The verdict is ``not an asset contract``; ``integrity`` if an asset is named but the contract is not the one derived from
    it; ``invalid`` if the rest is not as the kind asks; else ``ok``. Transfers, mints and clawbacks have two addresses (``first``,
    ``second``) before the name and an amount, bare or in a map; burns have one and a bare amount. Only ``ok`` rows have values.
    """
    c = F.col
    n = F.size("topics")
    rows = events.withColumn("kind", cv.text_of(_topic(0), "symbol"))
    name = F.when(F.coalesce(_is_contract_event(), F.lit(False)) & (n > 2) & c("kind").isin(*KINDS), cv.text_of(F.try_element_at("topics", F.lit(-1)), "string"))
    bits = F.split(name, ":")
    key = address.once(address.decode(F.get(bits, F.lit(1))), lambda d: F.when(d["kind"] == "account", d["key"]))
    issued = F.when((F.size(bits) == 2) & F.octet_length(bits[0]).between(1, 12) & key.isNotNull(), F.struct(F.lit(False).alias("native"), bits[0].alias("code"), key.alias("issuer")))
    native = F.struct(F.lit(True).alias("native"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("binary").alias("issuer"))
    rows = staged(rows, {"kind": c("kind"), "__name": name, "__asset": F.when(name == "native", native).otherwise(issued)})
    proven = F.when(c("__asset").isNotNull(), _proven(c("__asset"), network))
    burns = c("kind") == "burn"
    pairs = cv.entries(c("data"))
    in_map = F.get(F.filter(pairs, lambda e: cv.text_of(e["key"], "symbol") == "amount"), F.lit(0))["val"]
    texts = {f"__{k}": cv.text_of(_topic(i), "address") for k, i in (("first", 1), ("second", 2))}
    rows = staged(rows, texts | {"__proven": proven, "__amount": F.coalesce(cv.whole(c("data")), F.when(~burns, cv.whole(in_map)))})
    rows = staged(rows, {f"__{k}_fine": address.decode(c(f"__{k}"))["kind"].isNotNull() for k in ("first", "second")})
    right = F.when(burns, n == 3).otherwise((n == 4) & c("__second_fine")) & c("__first_fine") & c("__amount").isNotNull()
    verdict = F.when(c("__asset").isNull(), "not an asset contract").when(~c("__proven"), "integrity").when(~F.coalesce(right, F.lit(False)), "invalid").otherwise("ok")
    rows = staged(rows, {"verdict": verdict})
    ok = c("verdict") == "ok"
    found = {"kind": F.when(ok, c("kind")), "first": F.when(ok, c("__first")), "second": F.when(ok & ~burns, c("__second")), "amount": F.when(ok, c("__amount")), "asset": F.when(ok, c("__name"))}
    rows = rows.withColumns(found)
    return rows.drop(*[x for x in rows.columns if x.startswith("__")])


def fee_events(events: DataFrame, *, network: Column, on_error: str = "raise") -> DataFrame:
    """Fee movements from the events of whole transactions: (ledger, tx_index, source, amount, wrong).

    Every event must be a contract event of the plain form; those not named ``fee`` mean nothing. A fee has two topics, a
    128-bit amount and an address, and comes from the native asset's contract. A transaction has one or two. If anything
    is wrong, "raise" fails, "mark" gives that transaction one row with the first reason and no amounts. A transaction
    without events gives no row, as it is not in ``events``.
    """
    c = F.col
    nothing = F.lit(None)
    native = ids.contract_id(ids.asset_bytes(nothing.cast("string"), nothing.cast("binary")), network)
    rows = events.select("ledger", "tx_index", "type", "contract", "body_version", "topics", "data")
    rows = rows.withColumn("__name", cv.text_of(_topic(0), "symbol")).withColumn("source", cv.text_of(_topic(1), "address")).withColumn("amount", cv.whole(c("data")))
    fee = F.coalesce(c("__name") == "fee", F.lit(False))
    wrong = (
        F.when(~F.coalesce(_is_contract_event(), F.lit(False)), "format")
        .when(fee & (F.size("topics") != 2), "topics")
        .when(fee & c("amount").isNull(), "amount")
        .when(fee & address.decode(c("source"))["kind"].isNull(), "address")
        .when(fee & (c("contract") != native), "contract")
    )
    rows = staged(rows, {"fee": fee, "wrong": wrong}).select("ledger", "tx_index", "source", "amount", "fee", "wrong")
    whole = Window.partitionBy("ledger", "tx_index")
    rows = rows.withColumn("n", F.count_if("fee").over(whole)).withColumn("bad", F.min("wrong").over(whole)).withColumn("row", F.row_number().over(whole.orderBy(F.col("fee").desc(), "source", "amount")))
    reason = F.coalesce(c("bad"), F.when(c("n") == 0, "no fee").when(c("n") > 2, "too many fees"))
    rows = rows.select("ledger", "tx_index", F.when(reason.isNull(), c("source")).alias("source"), F.when(reason.isNull(), c("amount")).alias("amount"), reason.alias("wrong"), "fee", "row")
    rows = rows.where((c("wrong").isNull() & c("fee")) | (c("wrong").isNotNull() & (c("row") == 1))).drop("fee", "row")
    if on_error == "raise":
        rows = rows.withColumn("wrong", F.when(c("wrong").isNotNull(), F.raise_error(F.concat(F.lit("fee events: "), c("wrong"))).cast("string")))
    return rows
