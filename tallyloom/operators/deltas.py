"""Balance deltas from two sides, and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def legs(events: DataFrame, *, kind: str = "kind", source: str = "source", target: str = "target", asset: str = "asset", amount: str = "amount", keep: list[str] | None = None) -> DataFrame:
    """Two signed rows a transfer, one a mint, burn, clawback or fee: (…, holder, asset, delta). Events without an asset give none."""
    out = F.col(kind).isin("transfer", "burn", "clawback", "fee")
    into = F.col(kind).isin("transfer", "mint")
    rows = F.array(
        F.when(out, F.struct(F.col(source).alias("holder"), (-F.col(amount)).alias("delta"))),
        F.when(into, F.struct(F.col(target).alias("holder"), F.col(amount).alias("delta"))),
    )
    each = events.where(F.col(asset).isNotNull()).select(*(keep or []), F.col(asset).alias("asset"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("leg"))
    return each.select(*(keep or []), "leg.holder", "asset", "leg.delta")


def summed(legs_: DataFrame, *, keys: list[str], is_contract: Column | None = None) -> DataFrame:
    """Deltas by ``keys`` as decimals of 38 digits, zero sums left out; holders that are contracts are not followed."""
    rows = legs_ if is_contract is None else legs_.where(~is_contract)
    if rows.schema["delta"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return rows.groupBy(*keys).agg(F.sum(F.col("delta").cast("decimal(28,0)")).alias("delta")).where("delta <> 0")
    low = F.col("delta").cast("long").bitwiseAND(F.lit((1 << 32) - 1))  # sums of halves stay within longs
    halves = rows.groupBy(*keys).agg(F.sum(F.shiftright(F.col("delta").cast("long"), 32)).alias("__hi"), F.sum(low).alias("__lo"))
    whole = F.col("__hi").cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("__lo").cast("decimal(19,0)")
    return halves.select(*keys, whole.cast("decimal(38,0)").alias("delta")).where("delta <> 0")


def state_deltas(changes: DataFrame, *, keys: list[str], pre: str = "pre", post: str = "post") -> DataFrame:
    """Deltas of balances from states before and after, null states counting as 0."""
    rows = changes.select(*keys, (F.coalesce(F.col(post), F.lit(0)).cast("decimal(27,0)") - F.coalesce(F.col(pre), F.lit(0)).cast("decimal(27,0)")).alias("delta"))
    return summed(rows, keys=keys)


def mismatches(left: DataFrame, right: DataFrame, *, keys: list[str], value: str = "delta") -> DataFrame:
    """Keys whose values differ, also those that one side lacks: (…, left_value, right_value)."""
    a = left.select(*keys, F.col(value).alias("left_value"))
    b = right.select(*keys, F.col(value).alias("right_value"))
    return a.join(b, keys, "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def reconciled(left: DataFrame, right: DataFrame, *, keys: list[str], value: str = "delta") -> DataFrame:
    """What must be added to ``right`` so that it agrees with ``left``: a mint first where it lacks, a burn last where it has too much."""
    diff = F.coalesce(F.col("left_value"), F.lit(0)) - F.coalesce(F.col("right_value"), F.lit(0))
    rows = mismatches(left, right, keys=keys, value=value).withColumn("diff", diff).where("diff <> 0")
    return rows.select(*keys, F.when(F.col("diff") > 0, F.lit("mint")).otherwise(F.lit("burn")).alias("kind"), F.abs("diff").alias("amount"), F.when(F.col("diff") > 0, F.lit(0)).otherwise(F.lit(2)).alias("place"))


def pool_changes(changes: DataFrame, *, keys: list[str], pool: str = "pool_id") -> DataFrame:
    """How far an operation moved each reserve of a pool: (…, asset, amount), from states before and after (null: nothing)."""
    side = lambda x: F.struct(F.coalesce(F.col(f"post.asset_{x}"), F.col(f"pre.asset_{x}")).alias("asset"), F.abs(F.coalesce(F.col(f"post.reserve_{x}"), F.lit(0)) - F.coalesce(F.col(f"pre.reserve_{x}"), F.lit(0))).alias("amount"))
    return changes.select(*keys, pool, F.explode(F.array(side("a"), side("b"))).alias("s")).select(*keys, pool, "s.asset", "s.amount")


def held(entry: Column) -> Column:
    """What a ledger entry holds for whom, as an array of (holder, asset, amount); null for no entry and for other types.

    Accounts hold the native asset, trust lines theirs (those of pool shares, without an asset, nothing), claimable balances
    their amount under their own id, and pools both reserves. ``entry`` has type, account_id, balance, asset, balance_id,
    amount, pool_id, asset_a, asset_b, reserve_a and reserve_b.
    """
    one = lambda holder, asset, amount: F.struct(holder.alias("holder"), asset.alias("asset"), amount.cast("decimal(27,0)").alias("amount"))
    kind = entry["type"]
    found = (
        F.when(kind == "account", F.array(one(entry["account_id"], F.lit("native"), entry["balance"])))
        .when(kind == "trustline", F.array(one(entry["account_id"], entry["asset"], entry["balance"])))
        .when(kind == "claimable_balance", F.array(one(entry["balance_id"], entry["asset"], entry["amount"])))
        .when(kind == "liquidity_pool", F.array(one(entry["pool_id"], entry["asset_a"], entry["reserve_a"]), one(entry["pool_id"], entry["asset_b"], entry["reserve_b"])))
    )
    return F.filter(found, lambda x: x["asset"].isNotNull())


def entry_deltas(changes: DataFrame, *, keep: list[str] | None = None, pre: str = "pre", post: str = "post") -> DataFrame:
    """Balance deltas (…, holder, asset, delta) of changes of all kinds of entries: what the states after hold less what those before held.

    Zero sums are left out. Rows before and after are one bag with signs, so there is one aggregate with a map-side combine.
    """
    c, keep = F.col, keep or []
    signed = lambda entry, sign: F.transform(F.coalesce(held(c(entry)), F.array().cast("array<struct<holder:string,asset:string,amount:decimal(27,0)>>")), lambda x: F.struct(x["holder"].alias("holder"), x["asset"].alias("asset"), (x["amount"] * sign).cast("decimal(28,0)").alias("delta")))
    rows = changes.select(*keep, F.explode(F.concat(signed(pre, -1), signed(post, 1))).alias("x")).select(*keep, "x.*")
    return summed(rows, keys=[*keep, "holder", "asset"])
