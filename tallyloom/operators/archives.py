"""Checks of archives of ledger files: what is missing, what does not follow, what differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def islands(df: DataFrame, *, value: str, step: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Runs of values ``step`` apart as (first, last, n)."""
    keys = keys or []
    distinct = df.select(*keys, value).distinct()
    ranked = distinct.withColumn("__k", F.col(value) - step * F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
    return ranked.groupBy(*keys, "__k").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("__k")


def expected_files(spark: SparkSession, *, first: int, last: int, every: int, categories: list[str]) -> DataFrame:
    """The files that an archive of these checkpoints has: (category, checkpoint), made in parallel."""
    grid = spark.range(first, last + 1, every).select(F.col("id").alias("checkpoint"))
    return grid.select(F.explode(F.array(*[F.lit(c) for c in categories])).alias("category"), "checkpoint")


def missing(expected: DataFrame, present: DataFrame, *, keys: list[str]) -> DataFrame:
    return expected.join(present.select(*keys).distinct(), keys, "left_anti")


def chain_breaks(headers: DataFrame, *, sequence: str = "sequence", hash_: str = "hash", previous: str = "prev_hash", block: int = 1 << 20) -> DataFrame:
    """Headers that do not follow the one before: sequence not one more, or its hash not the one they name.

    Each header is joined with the one of the next lower number that it should follow, so nothing is sorted in one task;
    a header whose predecessor is not there, other than the first of all, is a break too.
    """
    before = headers.select((F.col(sequence) + 1).alias("__next"), F.col(hash_).alias("__hash"))
    joined = headers.join(before, F.col(sequence) == F.col("__next"), "left")
    least = headers.agg(F.min(sequence).alias("__least"))
    marked = joined.crossJoin(F.broadcast(least))  # one row
    why = F.when(F.col("__next").isNull(), F.lit("gap")).when(~F.col(previous).eqNullSafe(F.col("__hash")), F.lit("hash"))
    return marked.where(F.col(sequence) > F.col("__least")).withColumn("why", why).where("why is not null").select(*headers.columns, "why")


def as_of_forward(times: DataFrame, *, time: str, value: str, wanted: DataFrame, at: str, span: int = 1 << 16) -> DataFrame:
    """For each wanted time the first value at or after it; after the last, the last value.

    Both sides are merged by time and the next value is carried back within ranges of ``span``, each a window partition.
    What a range lacks is the first value of a later range, found over one row a range.
    """
    a = times.select(F.col(time).alias("t"), F.col(value).alias("v"), F.lit(None).cast("long").alias("w"))
    b = wanted.select(F.col(at).alias("t"), F.lit(None).cast(times.schema[value].dataType).alias("v"), F.lit(1).cast("long").alias("w"))
    rows = a.unionByName(b).withColumn("r", F.floor(F.col("t") / span))
    ahead = Window.partitionBy("r").orderBy(F.col("t").desc(), F.col("w").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    asked = rows.withColumn("found", F.last("v", ignorenulls=True).over(ahead)).where("w is not null")
    ranges = rows.groupBy("r").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("t"))).alias("head"))
    later = ranges.select("r", F.last("head", ignorenulls=True).over(Window.orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    last = a.agg(F.max_by("v", "t").alias("last"))
    out = asked.join(later, "r").crossJoin(F.broadcast(last))  # one row
    return out.select(F.col("t").alias(at), F.coalesce("found", "later", "last").alias(value))


def compare(expected: DataFrame, actual: DataFrame, *, keys: list[str], value: str, exempt: Column | None = None) -> DataFrame:
    """Expected values that are not the actual ones; a side that is not there can be ``exempt`` (a condition on the key)."""
    rows = expected.select(*keys, F.col(value).alias("expected")).join(actual.select(*keys, F.col(value).alias("actual")), keys, "left")
    bad = ~F.col("expected").eqNullSafe(F.col("actual"))
    return rows.where(bad if exempt is None else bad & ~(F.col("actual").isNull() & exempt))


def occupancy(levels: Column) -> Column:
    """A mark for each level (curr, snap, next): ``#`` if any is set, else ``_``."""
    zero = "0" * 64
    return F.array_join(F.transform(levels, lambda x: F.when((F.coalesce(x["curr"], F.lit(zero)) != zero) | (F.coalesce(x["snap"], F.lit(zero)) != zero) | (F.coalesce(x["next"], F.lit(zero)) != zero), F.lit("#")).otherwise(F.lit("_"))), "")


def changed_levels(now: Column, before: Column) -> Column:
    """Two marks a level (curr, snap): ``#`` where the hash is not the one before, else ``_``."""
    mark = lambda a, b: F.when(a.eqNullSafe(b), F.lit("_")).otherwise(F.lit("#"))
    return F.array_join(F.zip_with(now, before, lambda a, b: F.concat(mark(a["curr"], b["curr"]), mark(a["snap"], b["snap"]))), "")


def checkpoint_log(states: DataFrame, headers: DataFrame, *, checkpoint: str = "checkpoint", every: int = 64) -> DataFrame:
    """By checkpoint: its last close time, the transactions of its ledgers, and which levels changed since the one before.

    The state before is found by a join on the checkpoint's number, not by sorting all checkpoints in one task.
    """
    sums = headers.groupBy((F.ceil((F.col("sequence") + 1) / every).cast("long") * every - 1).alias(checkpoint)).agg(F.max_by("close_time", "sequence").alias("closed"), F.sum("tx_count").alias("txs"))
    before = states.select((F.col(checkpoint) + every).alias(checkpoint), F.col("levels").alias("__before"))
    joined = states.join(before, checkpoint, "left").join(sums, checkpoint, "left")
    return joined.select(checkpoint, "closed", "txs", F.when(F.col("__before").isNotNull(), changed_levels(F.col("levels"), F.col("__before"))).alias("changed"), occupancy(F.col("levels")).alias("occupied"))
