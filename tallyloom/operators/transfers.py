"""Token movements derived from operations, trades and fees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def movement_kind(*, asset_issuer: Column, source: Column, target: Column) -> Column:
    """Between an issuer and another holder tokens appear or vanish: ``mint`` or ``burn``; else ``transfer``. Native tokens have no issuer."""
    out, into = F.coalesce(source == asset_issuer, F.lit(False)), F.coalesce(target == asset_issuer, F.lit(False))
    return F.when(out & ~into, F.lit("mint")).when(into & ~out, F.lit("burn")).otherwise(F.lit("transfer"))


def trade_legs(atoms: DataFrame, *, keep: list[str], seller: str, taker: str, sold: str, sold_amount: str, bought: str, bought_amount: str) -> DataFrame:
    """Two movements for each trade an operation makes: what was sold to the taker, then what the taker paid."""
    c = F.col
    pair = F.array(
        F.struct(F.lit(0).alias("leg"), c(seller).alias("source"), c(taker).alias("target"), c(sold).alias("asset"), c(sold_amount).alias("amount")),
        F.struct(F.lit(1).alias("leg"), c(taker).alias("source"), c(seller).alias("target"), c(bought).alias("asset"), c(bought_amount).alias("amount")),
    )
    return atoms.select(*keep, F.explode(pair).alias("m")).select(*keep, "m.leg", "m.source", "m.target", "m.asset", "m.amount")


def operation_movements(ops: DataFrame) -> DataFrame:
    """Movements of simple operations of successful transactions, with their kind.

    ``ops`` has ledger, tx_index, op_index, tx_successful, type, op_source, destination, asset, issuer, amount,
    balance_id. Payments, account creations and merges (a null amount: none) move tokens from the operation's source to
    its destination; creating a claimable balance moves them to it and claiming from it; a clawback takes them from the
    holder.
    """
    c = F.col
    rows = ops.where(c("tx_successful") & c("type").isin("payment", "create_account", "account_merge", "create_claimable_balance", "claim_claimable_balance", "clawback")).where(c("amount").isNotNull())
    source = F.when(c("type") == "claim_claimable_balance", c("balance_id")).when(c("type") == "clawback", c("destination")).otherwise(c("op_source"))
    target = F.when(c("type") == "create_claimable_balance", c("balance_id")).when(c("type") == "claim_claimable_balance", c("op_source")).when(c("type") == "clawback", F.lit(None)).otherwise(c("destination"))
    native = c("type").isin("create_account", "account_merge")
    rows = rows.select("ledger", "tx_index", "op_index", source.alias("source"), target.alias("target"), F.when(native, F.lit("native")).otherwise(c("asset")).alias("asset"), c("amount"), "type", F.when(~native, c("issuer")).alias("issuer"))
    kind = F.when(c("type") == "clawback", F.lit("clawback")).otherwise(movement_kind(asset_issuer=c("issuer"), source=c("source"), target=c("target")))
    return rows.select("ledger", "tx_index", "op_index", kind.alias("kind"), "source", "target", "asset", "amount")


#: Operations whose trades move tokens. Fixed values.
TRADING = ("manage_buy_offer", "manage_sell_offer", "create_passive_sell_offer", "path_payment_strict_send", "path_payment_strict_receive")


def issuer_of(asset: Column) -> Column:
    """The issuer in ``code:issuer``; null for native."""
    return F.when(F.instr(asset, ":") > 0, F.substring_index(asset, ":", -1))


def all_movements(ops: DataFrame) -> DataFrame:
    """Movements of every kind of operation of successful transactions, in one pass: (ledger, tx_index, op_index, leg, kind, source, target, asset, amount).

    ``ops`` has what ``operation_movements`` takes but for the issuer, which is read from the asset (``native`` or
    ``code:issuer``), and ``atoms``, an array of trades (seller, sold, sold_amount, bought, bought_amount), and
    ``payouts``, an array of (destination, amount). Trades give two movements each; a path payment then one more, from
    the operation's source to its destination, of ``asset`` and ``amount`` (for a strict send what arrived). Inflation mints a
    payout each; a clawback of a claimable balance takes its amount from the balance. Movements of nothing are none.
    """
    c = F.col
    kind = F.lit(None).cast("string")
    one = lambda source, target, asset, amount, kind=kind: F.struct(source.alias("source"), target.alias("target"), asset.alias("asset"), amount.cast("long").alias("amount"), kind.alias("kind"))
    none, native = F.lit(None).cast("string"), F.lit("native")
    trades = F.flatten(F.transform(F.coalesce(c("atoms"), F.array().cast(ops.schema["atoms"].dataType)), lambda a: F.array(one(a["seller"], c("op_source"), a["sold"], a["sold_amount"]), one(c("op_source"), a["seller"], a["bought"], a["bought_amount"]))))
    paid = one(c("op_source"), c("destination"), c("asset"), c("amount"))
    legs = (
        F.when(c("type") == "payment", F.array(paid))
        .when(c("type").isin("create_account", "account_merge"), F.array(one(c("op_source"), c("destination"), native, c("amount"))))
        .when(c("type") == "create_claimable_balance", F.array(one(c("op_source"), c("balance_id"), c("asset"), c("amount"))))
        .when(c("type") == "claim_claimable_balance", F.array(one(c("balance_id"), c("op_source"), c("asset"), c("amount"))))
        .when(c("type") == "clawback", F.array(one(c("destination"), none, c("asset"), c("amount"), F.lit("clawback"))))
        .when(c("type") == "clawback_claimable_balance", F.array(one(c("balance_id"), none, c("asset"), c("amount"), F.lit("clawback"))))
        .when(c("type") == "inflation", F.transform("payouts", lambda p: one(none, p["destination"], native, p["amount"], F.lit("mint"))))
        .when(c("type").startswith("path_payment"), F.concat(trades, F.array(paid)))
        .when(c("type").isin(*TRADING), trades)
    )
    rows = ops.where("tx_successful").select("ledger", "tx_index", "op_index", F.posexplode(F.filter(legs, lambda m: m["amount"].isNotNull())).alias("leg", "m"))
    found = F.coalesce(c("m.kind"), movement_kind(asset_issuer=issuer_of(c("m.asset")), source=c("m.source"), target=c("m.target")))
    return rows.select("ledger", "tx_index", "op_index", "leg", found.alias("kind"), "m.source", "m.target", "m.asset", "m.amount")


def muxed_info(memo_kind: Column, text: Column, number: Column, binary: Column, *, muxed_id: Column | None = None) -> Column:
    """What marks the payee of a movement: the number in a muxed destination, else the memo, as (kind, value); null without either."""
    mark = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    memo = F.when(memo_kind == "id", mark("id", number.cast("string"))).when(memo_kind == "text", mark("text", text)).when(memo_kind.isin("hash", "return"), mark("hash", F.base64(binary)))
    return memo if muxed_id is None else F.when(muxed_id.isNotNull(), mark("id", muxed_id.cast("string"))).otherwise(memo)


def pool_movements(ops: DataFrame) -> DataFrame:
    """Deposits into and withdrawals from pools, one movement for each of the two assets.

    A deposit's amounts must be above 0; a withdrawal's of 0 give no movement but are allowed.
    """
    c = F.col
    bad = (c("type") == "pool_deposit") & ((c("amount_a") <= 0) | (c("amount_b") <= 0))
    two = F.array(F.struct(c("asset_a").alias("asset"), c("amount_a").alias("amount")), F.struct(c("asset_b").alias("asset"), c("amount_b").alias("amount")))
    rows = ops.where(c("tx_successful") & c("type").isin("pool_deposit", "pool_withdraw")).withColumn("two", F.when(bad, F.raise_error(F.lit("deposit of nothing")).cast("array<struct<asset:string,amount:bigint>>")).otherwise(two))
    rows = rows.select("*", F.explode("two").alias("m")).where("m.amount > 0")
    into = c("type") == "pool_deposit"
    return rows.select("ledger", "tx_index", "op_index", F.lit("transfer").alias("kind"), F.when(into, c("op_source")).otherwise(c("pool_id")).alias("source"), F.when(into, c("pool_id")).otherwise(c("op_source")).alias("target"), "m.asset", "m.amount")


def fee_movements(txs: DataFrame) -> DataFrame:
    """One fee movement a transaction, failed ones too, and one of opposite sign where part was given back."""
    c = F.col
    both = F.array(F.struct(F.lit("fee").alias("step"), c("fee_charged").alias("amount")), F.when(c("fee_refund") > 0, F.struct(F.lit("refund").alias("step"), (-c("fee_refund")).alias("amount"))))
    rows = txs.select("ledger", "protocol", "tx_index", "tx_source", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("f"))
    return rows.select("ledger", "protocol", "tx_index", "f.step", F.col("tx_source").alias("source"), "f.amount")


def event_order(events: DataFrame, *, ledger: str = "ledger", step: str = "step", tx: str = "tx_index", order: list[str], protocol: str = "protocol", out: str = "place") -> DataFrame:
    """``events`` with their place in the ledger: all fees first; then, by protocol, refunds after all operations (23 on) or after their own transaction."""
    late = F.when(F.col(protocol) >= 23, F.when(F.col(step) == "refund", 2).when(F.col(step) == "fee", 0).otherwise(1)).otherwise(F.when(F.col(step) == "fee", 0).otherwise(1))
    w = Window.partitionBy(ledger).orderBy(late, tx, F.when(F.col(step) == "refund", 1).otherwise(0), *order)
    return events.withColumn(out, F.row_number().over(w).cast("long"))


def claimed_balances(changes: DataFrame, *, on_error: str = "raise") -> DataFrame:
    """What operations that claim a balance moved: (ledger, tx_index, op_index, balance_id, asset, amount, wrong).

    ``changes`` of such operations: (ledger, tx_index, op_index, type, kind, balance_id, asset, amount), the last three of the state
    before. Exactly one claimable balance must be removed by an operation: "raise" fails for none or several, "mark" says
    so in ``wrong`` with nulls for the rest. One aggregate by operation, combined map-side.
    """
    c = F.col
    gone = (c("type") == "claimable_balance") & (c("kind") == "removed")
    one = F.struct("balance_id", "asset", "amount")
    ops = changes.groupBy("ledger", "tx_index", "op_index").agg(F.count_if(F.coalesce(gone, F.lit(False))).alias("n"), F.max(F.when(gone, one)).alias("b"))
    wrong = F.when(c("n") == 0, "no balance is removed").when(c("n") > 1, "several balances are removed")
    out = ops.select("ledger", "tx_index", "op_index", *[F.when(c("n") == 1, c(f"b.{f}")).alias(f) for f in ("balance_id", "asset", "amount")], wrong.alias("wrong"))
    if on_error == "raise":
        out = out.withColumn("wrong", F.when(c("wrong").isNotNull(), F.raise_error(c("wrong")).cast("string")))
    return out
