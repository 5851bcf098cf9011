"""Columns derived from nested ledgers, transactions, changes and entries.

Versions of a structure are nullable columns beside each other (``v1``, ``v2``); a field is read from the one that is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.operators import flatten

#: What tells entries of a type apart. Fixed values of the format.
ENTRY_KEYS = {
    "account": ("account",), "trustline": ("account", "asset"), "offer": ("seller", "offer_id"), "data": ("account", "name"), "claimable_balance": ("balance_id",),
    "liquidity_pool": ("pool_id",), "contract_data": ("contract", "key", "durability"), "contract_code": ("hash",), "config_setting": ("setting_id",), "ttl": ("key_hash",),
}


def ledger_fields(ledgers: DataFrame) -> DataFrame:
    """Ledgers (sequence, v1, v2, close) with the write fee (version 1 with an extension only), live state size and who signed the close."""
    c = F.col
    return ledgers.select("sequence", c("v1.ext.fee_write_1kb").alias("fee_write_1kb"), F.coalesce("v1.live_bytes", "v2.live_bytes").alias("live_bytes"), c("close.signed.node_id").alias("node_id"), c("close.signed.signature").alias("signature"))


def evicted_keys(ledgers: DataFrame) -> DataFrame:
    """(sequence, key) of what left the live state."""
    return ledgers.select("sequence", F.explode(F.coalesce("v1.evicted", "v2.evicted")).alias("key"))


def contract_data(v1: Column, fee_bump: Column) -> Column:
    """The contract part of an envelope, the inner one of a fee bump; null for other transactions."""
    return F.coalesce(v1["ext"], fee_bump["inner"]["ext"])


def contract_fields(txs: DataFrame) -> DataFrame:
    """``txs`` (v1, fee_bump, fee) with resources and fees of contract calls, nulls for others."""
    d = contract_data(F.col("v1"), F.col("fee_bump"))
    return txs.withColumns({"is_contract": d.isNotNull(), "resource_fee": d["resource_fee"], "instructions": d["instructions"], "read_bytes": d["read_bytes"], "write_bytes": d["write_bytes"], "inclusion_bid": F.col("fee") - d["resource_fee"]})


def balances(changes: Column, account: Column) -> Column:
    """The account's balance before and after an entry list (array of type, account, balance): the last state and the last update; 0 where there is none."""
    last = lambda kind: F.coalesce(F.get(F.reverse(F.filter(changes, lambda x: (x["type"] == kind) & (x["account"] == account))), F.lit(0))["balance"], F.lit(0))
    return F.struct(last("state").alias("before"), last("updated").alias("after"))


def original_fee(fee_changes: Column, account: Column) -> Column:
    """What was first taken from the account; more after than before is an error."""
    b = balances(fee_changes, account)
    return F.when(b["after"] > b["before"], F.raise_error(F.lit("fee below 0")).cast("long")).otherwise(b["before"] - b["after"])


def fee_refund(after_tx: Column, after_apply: Column, account: Column, *, contract: Column) -> Column:
    """What a contract call got back, 0 for other transactions; less after than before is an error."""
    b = balances(F.concat(after_tx, after_apply), account)
    return F.when(~contract, F.lit(0)).when(b["before"] > b["after"], F.raise_error(F.lit("refund below 0")).cast("long")).otherwise(b["after"] - b["before"])


def resource_fees(v3: Column) -> Column:
    """The three parts of a resource fee that version 3 of a transaction's meta holds; nulls for others."""
    ext = v3["contract"]["ext"]
    return F.struct(ext["non_refundable"].alias("non_refundable"), ext["refundable"].alias("refundable"), ext["rent"].alias("rent"))


def slots(events: Column, contract: Column) -> Column:
    """Events by operation: a contract call has exactly one slot, other transactions none."""
    return F.when(contract, F.array(F.coalesce(events, F.array().cast("array<string>")))).otherwise(F.array().cast("array<array<string>>"))


def entry_key(entry: Column) -> Column:
    """The key of an entry (a struct with ``type`` and the fields of ``ENTRY_KEYS``) as text; null for other types."""
    out = F.lit(None).cast("string")
    for kind, fields in ENTRY_KEYS.items():
        out = F.when(entry["type"] == kind, F.concat_ws("|", F.lit(kind), *[entry[f].cast("string") for f in fields])).otherwise(out)
    return out


def change_key(pre: Column, post: Column) -> Column:
    """The key of a change, by the entry before it or else by the one after it."""
    return F.coalesce(entry_key(pre), entry_key(post))


#: Account fields that older entries lack, with what they then count as. Fixed values.
ACCOUNT_DEFAULTS = {"buying_liabilities": 0, "selling_liabilities": 0, "num_sponsored": 0, "num_sponsoring": 0, "seq_ledger": 0, "seq_time": 0}


def normal_account(entry: Column, fields: list[str]) -> Column:
    """An account entry with ``fields`` and with all that older entries lack filled in."""
    return F.struct(*[(F.coalesce(entry[f], F.lit(ACCOUNT_DEFAULTS[f])) if f in ACCOUNT_DEFAULTS else entry[f]).alias(f) for f in fields])


#: What entries of each type count as having where they have no such field yet. Fixed values.
ENTRY_DEFAULTS = {"account": ACCOUNT_DEFAULTS, "trustline": {"buying_liabilities": 0, "selling_liabilities": 0}, "claimable_balance": {"flags": 0}}
#: Lists without an order of their own, and what they are sorted by.
ENTRY_LISTS = {"account": {"signers": "key"}, "claimable_balance": {"claimants": "destination"}}
#: Fields that no comparison looks at.
ENTRY_IGNORED = {"trustline": ("pool_use_count",)}


def normal_entry(entry: Column, fields: list[str], kind: str) -> Column:
    """An entry of a type with ``fields`` in the form in which two are compared: defaults filled in, lists sorted, ignored fields left out.

    Signers carry their sponsors with them (``sponsored_signers``). Null entries stay null.
    """
    defaults, lists, ignored = ENTRY_DEFAULTS.get(kind, {}), ENTRY_LISTS.get(kind, {}), ENTRY_IGNORED.get(kind, ())

    def one(f: str) -> Column:
        if f in lists:
            return flatten.sorted_by(F.coalesce(entry[f], F.array()), lists[f])
        return F.coalesce(entry[f], F.lit(defaults[f])) if f in defaults else entry[f]

    return F.when(entry.isNotNull(), F.struct(*[one(f).alias(f) for f in fields if f not in ignored]))


def sponsored_signers(signers: Column, sponsors: Column) -> Column:
    """Signers (key, weight), each with its ``sponsor`` from a list of the same order, null where that is shorter."""
    return F.transform(signers, lambda s, i: F.struct(s["key"].alias("key"), s["weight"].alias("weight"), F.get(sponsors, i).alias("sponsor")))


def entry_changed(pre: Column, post: Column, fields: list[str], kind: str) -> Column:
    """Do two states of an entry differ in more than form? A missing side is a change."""
    return pre.isNull() | post.isNull() | ~normal_entry(pre, fields, kind).eqNullSafe(normal_entry(post, fields, kind))


def account_changed(pre: Column, post: Column, fields: list[str]) -> Column:
    """Did an account change in anything but its signers (which ``fields`` leave out)? A missing side is a change."""
    return pre.isNull() | post.isNull() | ~normal_account(pre, fields).eqNullSafe(normal_account(post, fields))


def thresholds(packed: Column) -> Column:
    """The master weight and the three thresholds in four bytes (binary)."""
    one = lambda k: F.conv(F.hex(F.substring(packed, k, 1)), 16, 10).cast("int")
    return F.struct(one(1).alias("master"), one(2).alias("low"), one(3).alias("medium"), one(4).alias("high"))


def claim(atom: Column) -> Column:
    """Seller, sold and bought of a trade, from whichever of its three forms is there; a pool stands for the seller of its own."""
    pick = lambda f: F.coalesce(atom["v0"][f], atom["book"][f], atom["pool"][f])
    return F.struct(F.coalesce(atom["v0"]["seller"], atom["book"]["seller"], atom["pool"]["pool_id"]).alias("seller"), *[pick(f).alias(f) for f in ("sold", "sold_amount", "bought", "bought_amount")])


def result_name(kind: Column, code: Column, names: dict[tuple[str, int], str]) -> Column:
    """The name of an operation's result by its type and code; null if there is none."""
    pairs = [F.lit(x) for (k, n), v in names.items() for x in (f"{k}:{n}", v)]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws(":", kind, code.cast("string")))


def balance_id(results: Column, op_index: Column) -> Column:
    """The claimable balance that the operation at an index (from 0) made; null if it is no such or the index is none of its."""
    return F.get(results, op_index.cast("int"))["balance_id"]


def signer_sponsors(signers: Column, sponsors: Column) -> Column:
    """Sponsors by signer, of the signers that have one; both arrays are in the same order."""
    pairs = F.zip_with(signers, sponsors, lambda s, p: F.struct(s.alias("key"), p.alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))


def asset_order(kind: Column, code: Column, issuer_key: Column) -> Column:
    """Sorts assets as their encoding does: by type, code, then the bytes of the issuer's key (not its text)."""
    rank = F.when(kind == "native", 0).when(kind == "credit_alphanum4", 1).when(kind == "credit_alphanum12", 2).otherwise(3)
    return F.struct(rank.alias("rank"), F.coalesce(code, F.lit("")).alias("code"), F.coalesce(issuer_key, F.lit("").cast("binary")).alias("key"))


def scan_status(*, cursor: Column, first: Column, last: Column, oldest: Column, newest: Column, ascending: Column) -> Column:
    """Where a scan of ledgers [first, last] that has come to ``cursor`` (the next ledger) stands on a node that holds [oldest, newest]."""
    done = F.when(ascending, cursor > last).otherwise(cursor < first)
    return F.when(done, F.lit("COMPLETE")).when(ascending & (cursor > newest), F.lit("WAITING_FOR_LEDGERS")).when(~ascending & (cursor < oldest), F.lit("OLDEST_REACHED")).otherwise(F.lit("HAS_MORE"))


def with_transaction(operations: DataFrame, txs: DataFrame, *, hash_: str = "hash") -> DataFrame:
    """Operations with their whole transaction in ``transaction``, null where it is not there."""
    inline = txs.select(F.col(hash_).alias("__hash"), F.struct(*txs.columns).alias("transaction"))
    return operations.join(inline, F.col(hash_) == F.col("__hash"), "left").drop("__hash")


def response_body(body: Column, domain: Column, *, drop: tuple[str, ...] = (r'"result_meta_xdr": ?"[^"]*",?', r'"latest_ledger": ?[0-9]+,?')) -> Column:
    """A response without its server's address and without what servers may differ in."""
    out = F.replace(body, domain, F.lit(""))
    for pattern in drop:
        out = F.regexp_replace(out, pattern, "")
    return out


def differing_responses(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths whose bodies (path, body) differ between two servers, or that one of them lacks."""
    one, two = a.select("path", F.col("body").alias("body_a")), b.select("path", F.col("body").alias("body_b"))
    return one.join(two, "path", "full").where(~F.col("body_a").eqNullSafe(F.col("body_b")))
