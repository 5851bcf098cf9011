"""Entries of contract storage that describe an asset or a holder's balance of it."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions import address, contract_values as cv, derived_ids as ids
from tallyloom.functions.staged import staged

#: Keys and names in the storage of an asset's contract. Fixed values of the format.
ASSET_INFO = '{"vec":[{"symbol":"AssetInfo"}]}'
BALANCE = "Balance"


def is_asset_key(key: Column, durability: Column) -> Column:
    """Could an entry of this key describe an asset? Only a persistent contract instance."""
    return F.coalesce(durability == "persistent", F.lit(False)) & cv.has(key, "ledger_key_contract_instance")


def is_balance_key(key: Column, durability: Column) -> Column:
    """Could an entry of this key be a balance? Only a persistent one whose key is a vec of the symbol ``Balance`` and one more."""
    named = (cv.at(key, "$.vec[0].symbol", "string") == BALANCE) & cv.at(key, "$.vec[1]").isNotNull() & cv.at(key, "$.vec[2]").isNull()
    return F.coalesce((durability == "persistent") & named, F.lit(False))


def _native(network: Column) -> Column:
    nothing = F.lit(None)
    return ids.contract_id(ids.asset_bytes(nothing.cast("string"), nothing.cast("binary")), network)


def asset_rows(entries: DataFrame, *, network: Column) -> DataFrame:
    """``entries`` (contract: binary, durability, key and val: variant) that describe an asset, with ``code`` and ``issuer`` (a key).

    The key must be that of a persistent contract instance whose storage holds, under ``[AssetInfo]`` (the first such), a
    vec of the symbol ``AlphaNum4`` or ``AlphaNum12`` and a map of exactly ``asset_code`` (a text that is not empty) and ``issuer``
    (32 bytes), in this order; and the contract's id must be the one derived from that asset, so forged entries fall out.
    Codes are of letters and digits, up to 12. The native asset is left out. Nulls anywhere: no row. Other columns pass.
    """
    c = F.col
    rows = entries.where(is_asset_key(c("key"), c("durability")) & (c("contract") != _native(network)))
    storage = cv.entries(c("val"), "$.instance.storage")
    info = F.get(F.filter(storage, lambda e: cv.canonical(e["key"]) == ASSET_INFO), F.lit(0))["val"]
    rows = staged(rows, {"__info": cv.items(info)}).where(F.size("__info") == 2)
    rows = staged(rows.where(cv.text_of(c("__info")[0], "symbol").isin("AlphaNum4", "AlphaNum12")), {"__map": cv.entries(c("__info")[1])})
    rows = rows.where((F.size("__map") == 2) & (cv.text_of(c("__map")[0]["key"], "symbol") == "asset_code") & (cv.text_of(c("__map")[1]["key"], "symbol") == "issuer"))
    rows = staged(rows, {"code": cv.text_of(c("__map")[0]["val"], "string"), "issuer": cv.blob(c("__map")[1]["val"])})
    rows = rows.where(c("code").rlike("^[a-zA-Z0-9]{1,12}$") & (c("contract") == ids.contract_id(ids.asset_bytes(c("code"), c("issuer")), network)))
    return rows.drop("__info", "__map")


def balance_rows(entries: DataFrame, *, network: Column) -> DataFrame:
    """``entries`` that are a contract's balance of an asset, with ``holder`` (the address), ``holder_key`` and ``amount`` (decimal text, as wide as 128 bits).

    The key must be a persistent ``[Balance, address]`` whose address is a contract's, and the value a map of exactly ``amount``
    (a 128-bit number of 0 or more), ``authorized`` and ``clawback`` (both bool), in this order. Balances of the native asset are
    left out. Whose asset it is, the contract's asset row says. Nulls anywhere: no row. Other columns pass.
    """
    c = F.col
    rows = entries.where(is_balance_key(c("key"), c("durability")) & (c("contract") != _native(network)))
    rows = staged(rows, {"holder": cv.at(c("key"), "$.vec[1].address", "string")}).where(address.kind_of(c("holder")) == "contract")
    # By path, as the map's entries as values of their own would each be written anew.
    named = [cv.at(c("val"), f"$.map[{i}].key.symbol", "string") == name for i, name in enumerate(("amount", "authorized", "clawback"))]
    flags = [cv.at(c("val"), f"$.map[{i}].val.bool", "boolean").isNotNull() for i in (1, 2)]
    rows = rows.where(functools.reduce(lambda x, y: x & y, [*named, *flags, cv.at(c("val"), "$.map[3]").isNull()]))
    rows = staged(rows, {"amount": cv.whole(cv.at(c("val"), "$.map[0].val"))}).where(~c("amount").startswith("-"))
    # Last and once, as addresses are read in Python and rows wait for it: of those that are left, without what was looked at before.
    rows = staged(rows, {"__holder": address.decode(c("holder"))}).where(c("__holder.kind") == "contract")
    return rows.withColumn("holder_key", c("__holder.key")).drop("__holder")
