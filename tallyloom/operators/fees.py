"""Fees of transactions: classification and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PERCENTILES = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99)


def operation_count(code: Column, results: Column, inner_code: Column, inner_results: Column) -> Column:
    """How many operations a transaction's result lists, a fee bump's the inner one; 0 where codes go without a list."""
    listing = ("success", "failed")
    own = F.when(code.isin(*listing), F.size(results))
    inner = F.when(code.isin(*[f"fee_bump_inner_{c}" for c in listing]) & inner_code.isin(*listing), F.size(inner_results))
    return F.greatest(F.coalesce(own, inner, F.lit(0)), F.lit(0))


def fee_bucket(*, charged: Column, operations: Column, contract: Column, resource: Column) -> Column:
    """(bucket, fee): ``classic`` with the fee an operation, ``inclusion`` with the fee beyond resources, or null.

    Without results there is nothing to classify. Negative fees, or resources above the charge, are errors.
    """
    bad = (charged < 0) | (contract & ((resource < 0) | (resource > charged)))
    classic = F.struct(F.lit("classic").alias("bucket"), F.floor((charged - F.pmod(charged, operations)) / operations).cast("long").alias("fee"))
    inclusion = F.struct(F.lit("inclusion").alias("bucket"), (charged - resource).cast("long").alias("fee"))
    none = F.struct(F.lit(None).cast("string").alias("bucket"), F.lit(None).cast("long").alias("fee"))
    return F.when(bad, F.raise_error(F.lit("fee out of range")).cast("struct<bucket:string,fee:bigint>")).when(contract, inclusion).when(F.coalesce(operations, F.lit(0)) <= 0, none).otherwise(classic)


def distribution(df: DataFrame, *, keys: list[str], fee: str) -> DataFrame:
    """Count, least, greatest, mode (of several the least) and nearest-rank percentiles of ``fee`` by ``keys``."""
    whole = F.col(fee).cast("long")
    cols = [F.count(whole).alias("n"), F.min(whole).alias("least"), F.max(whole).alias("most"), F.expr(f"mode() within group (order by cast({fee} as bigint))").alias("usual")]
    cols += [F.expr(f"cast(percentile_disc({p / 100}) within group (order by cast({fee} as bigint)) as bigint)").alias(f"p{p}") for p in PERCENTILES]
    return df.groupBy(*keys).agg(*cols)
