"""Nested ledgers taken apart: ledgers of a batch, transactions, operations, changes and events, and what is derived of them.

A ledger has ``sequence``, ``protocol`` and two arrays: ``envelopes`` (what was asked for, in order of hash) and
``processing`` (what was done, in order of application). Both name a transaction by its ``hash``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions import ids

SUCCESS = ("success", "fee_bump_inner_success")


def ledgers(batches: DataFrame, *, array: str = "ledgers") -> DataFrame:
    """The ledgers of file batches (start, end, ledgers); one outside its batch's range is an error."""
    rows = batches.select("start", "end", F.explode(array).alias("l"))
    bad = (F.col("l.sequence") < F.col("start")) | (F.col("l.sequence") > F.col("end"))
    return rows.select(F.when(bad, F.raise_error(F.lit("ledger outside its batch")).cast(rows.schema["l"].dataType)).otherwise(F.col("l")).alias("l")).select("l.*")


def envelopes(tx_set: Column) -> Column:
    """All envelopes of a ledger's set in order: the ``txs`` of old sets, else phase by phase those of its ``components`` or those of the clusters of its parallel ``stages``.

    What is missing counts as empty; only envelopes themselves may be null.
    """
    there = lambda a: F.filter(a, lambda x: x.isNotNull())

    def of_phase(p: Column) -> Column:
        return F.coalesce(F.flatten(there(F.transform(p["components"], lambda x: x["txs"]))), F.flatten(there(F.flatten(there(p["stages"])))))

    return F.coalesce(tx_set["txs"], F.flatten(there(F.transform(tx_set["phases"], of_phase))))


def transactions(nested: DataFrame, *, envelopes: str = "envelopes", processing: str = "processing") -> DataFrame:
    """One row a transaction: ledger, protocol, ``tx_index`` from 1 in order of application, ``done`` and ``asked``.

    Envelopes are matched by hash inside the ledger's row, without a shuffle; a transaction without one is an error, as
    are two envelopes of one hash in a ledger.
    """
    by_hash = F.map_from_entries(F.transform(envelopes, lambda e: F.struct(e["hash"].alias("key"), e.alias("value"))))

    def matched(found: Column) -> Column:
        return F.transform(processing, lambda d: F.struct(d.alias("done"), F.try_element_at(found, d["hash"]).alias("asked")))

    # The array of one binds the map to a name, so that it is built once a ledger.
    pairs = F.get(F.transform(F.array(by_hash), matched), F.lit(0))
    rows = nested.select(F.col("sequence").alias("ledger"), "protocol", F.posexplode(pairs).alias("at", "t"))
    lost = F.raise_error(F.concat(F.lit("no envelope for transaction "), F.col("t.done.hash"))).cast(nested.schema[envelopes].dataType.elementType)
    asked = F.when(F.col("t.asked").isNull(), lost).otherwise(F.col("t.asked"))
    return rows.select("ledger", F.col("t.done.hash").alias("hash"), "protocol", (F.col("at") + 1).cast("long").alias("tx_index"), F.col("t.done").alias("done"), asked.alias("asked"))


def operations(txs: DataFrame, *, array: str = "asked.operations", source: str = "source") -> DataFrame:
    """One row an operation, with its position; its source is the transaction's where it names none."""
    rows = txs.select("ledger", "tx_index", "hash", F.col(f"asked.{source}").alias("__tx_source"), F.col("done.result_code").isin(*SUCCESS).alias("tx_successful"), F.posexplode(array).alias("at", "op"))
    op = (F.col("at") + 1).cast("long")
    return rows.select("ledger", "tx_index", op.alias("op_index"), ids.position(F.col("ledger"), F.col("tx_index"), op).alias("position"), "hash", "tx_successful", F.coalesce(F.col(f"op.{source}"), F.col("__tx_source")).alias("op_source"), "op")


def paired_changes(entries: Column) -> Column:
    """Changes of an entry list (array of type, key, entry): a ``state`` is the pre of the entry that follows it.

    Created and restored entries have a post alone, unless a state stands before a restored one; updated and removed
    ones have the pre that stands before them. States are no changes.
    """

    def change(x: Column, i: Column) -> Column:
        before = F.get(entries, i - 1)
        pre = F.when((before["type"] == "state") & (x["type"] != "created"), before["entry"])
        post = F.when(x["type"] != "removed", x["entry"])
        return F.struct(x["type"].alias("type"), x["key"].alias("key"), pre.alias("pre"), post.alias("post"))

    return F.filter(F.transform(entries, change), lambda c: c["type"] != "state")


def changes(txs: DataFrame, *, array: str = "done.changes") -> DataFrame:
    """One row a change of a transaction, in order."""
    rows = txs.withColumn("__c", F.col(array)).select("ledger", "tx_index", F.posexplode(paired_changes(F.col("__c"))).alias("ord", "c"))
    return rows.select("ledger", "tx_index", F.col("ord").cast("long").alias("ord"), "c.*")


def events(txs: DataFrame, *, array: str = "done.events") -> DataFrame:
    """One row an event, with its cursor."""
    rows = txs.select("ledger", "tx_index", F.posexplode(array).alias("at", "e"))
    return rows.select("ledger", "tx_index", ids.cursor(ids.position(F.col("ledger"), F.col("tx_index"), F.coalesce(F.col("e.op_index"), F.lit(0))), F.col("at")).alias("cursor"), "e.*")


def meta_events(meta: Column, *, contract: Column | None = None) -> Column:
    """Events that a transaction's meta holds, by its ``version``: (of_transaction, of_operations, diagnostic), none of them null.

    Versions to 2 have none. Version 3 has those of its ``contract`` part, as the one operation's; where the column
    ``contract`` is given, only contract calls have them. Version 4 has ``events``, ``operations`` with ``events``, and
    ``diagnostics``. Other versions are an error.
    """
    version, part = meta["version"], meta["contract"]
    called = part.isNotNull() if contract is None else part.isNotNull() & F.coalesce(contract, F.lit(False))
    none = F.array()
    fourth, third = version == 4, (version == 3) & called
    of_transaction = F.coalesce(F.when(fourth, meta["events"]), none)
    by_operation = F.transform(meta["operations"], lambda o: F.coalesce(o["events"], none))
    of_operations = F.coalesce(F.when(fourth, by_operation).when(third, F.array(F.coalesce(part["events"], none))), none)
    diagnostic = F.coalesce(F.when(fourth, meta["diagnostics"]).when(third, part["diagnostics"]), none)
    found = F.struct(of_transaction.alias("of_transaction"), of_operations.alias("of_operations"), diagnostic.alias("diagnostic"))
    return F.when(version.between(0, 4), found).otherwise(F.raise_error(F.concat(F.lit("meta of version "), F.coalesce(version.cast("string"), F.lit("null")))))


def event_rows(txs: DataFrame, *, keep: list[str], events: str = "events") -> DataFrame:
    """One row an event of ``meta_events``: ``part``, ``op_index`` (from 1, of operations' events), ``at`` (from 0) and ``event``."""
    whole = F.col(events)

    def listed(part: str, found: Column, op: Column) -> Column:
        return F.transform(found, lambda e, i: F.struct(F.lit(part).alias("part"), op.cast("long").alias("op_index"), i.cast("long").alias("at"), e.alias("event")))

    by_operation = F.flatten(F.transform(whole["of_operations"], lambda es, k: listed("operation", es, k + 1)))
    no = F.lit(None)
    return txs.select(*keep, F.inline(F.concat(listed("transaction", whole["of_transaction"], no), by_operation, listed("diagnostic", whole["diagnostic"], no))))


def close_ms(seconds: Column, ms: Column) -> Column:
    """When a ledger closed, in milliseconds: as given, else from seconds."""
    return F.coalesce(ms, seconds.cast("long") * 1000)


def memo_text(kind: Column, text: Column, number: Column, binary: Column) -> Column:
    return F.when(kind == "text", text).when(kind == "id", number.cast("string")).when(kind.isin("hash", "return"), F.base64(binary)).otherwise(F.lit(""))


def bounds_text(low: Column, high: Column) -> Column:
    """``[low,high)``, open above where high is 0; null without bounds."""
    return F.when(low.isNotNull(), F.concat(F.lit("["), low.cast("string"), F.lit(","), F.when(high != 0, high.cast("string")).otherwise(F.lit("")), F.lit(")")))


def fee_charged(charged: Column, refund: Column, *, contract: Column, fee_bump: Column, protocol: Column) -> Column:
    """What a transaction paid; before protocol 21 a fee bump of a contract call was recorded before its refund."""
    return F.when(contract & fee_bump & (protocol < 21), charged - refund).otherwise(charged)


def inclusion_fee(charged: Column, resource: Column, operations_: Column, *, contract: Column, fee_bump: Column) -> Column:
    """What was paid to be included: beyond resources for contract calls, else by operation, a fee bump counting as one."""
    count = operations_ + F.when(fee_bump, 1).otherwise(0)
    return F.when(contract, charged - resource).when(count > 0, F.floor((charged - F.pmod(charged, count)) / count).cast("long"))


def receive_source_amount(last_amount: Column, atoms: Column) -> Column:
    """What a strict-receive payment cost: the last amount without trades, else the amounts bought in the first run of trades of one asset."""
    run = F.aggregate(atoms, F.struct(F.lit(True).alias("on"), F.lit(0).cast("long").alias("sum")), lambda a, x: F.when(a["on"] & (x["asset_bought"] == F.get(atoms, F.lit(0))["asset_bought"]), F.struct(F.lit(True).alias("on"), (a["sum"] + x["amount_bought"]).alias("sum"))).otherwise(F.struct(F.lit(False).alias("on"), a["sum"].alias("sum"))))
    return F.when(F.size(atoms) == 0, last_amount).otherwise(run["sum"])


def signer_weights(signers: Column, account: Column, master: Column) -> Column:
    """Weights by signer, the account itself with its master weight included where that is not 0."""
    own = F.when(master != 0, F.array(F.struct(account.alias("key"), master.alias("weight")))).otherwise(F.array().cast("array<struct<key:string,weight:int>>"))
    return F.map_from_entries(F.concat(F.transform(signers, lambda s: F.struct(s["key"].alias("key"), s["weight"].cast("int").alias("weight"))), own.cast("array<struct<key:string,weight:int>>")))


def sorted_by(items: Column, field: str) -> Column:
    """Structs in order of a field, as claimants by destination or signers by key."""
    return F.array_sort(items, lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0))
