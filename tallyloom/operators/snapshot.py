"""Newest-wins merging of layered snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def layer_rank(level: Column, slot: Column) -> Column:
    """Layers from newest to oldest: by level, the current one before the one it came from."""
    return level * 2 + F.when(slot == "snap", 1).otherwise(0)


def newest(entries: DataFrame, *, keys: list[str], newest_first: list[Column], dead: Column, keep: Column | None = None) -> DataFrame:
    """The newest entry of each key, if it is not ``dead``; a dead one hides all older ones.

    ``keep`` is applied before entries hide each other: a newer entry that fails it hides nothing. Aggregates the newest
    row of a key with a map-side combine rather than ranking all rows.
    """
    rows = entries if keep is None else entries.where(keep)
    columns = entries.columns
    rows = rows.withColumn("__dead", dead)
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(newest_first)])
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns, "__dead"), order).alias("row"))
    return best.where(~F.col("row.__dead")).select(*[F.col(f"row.{c}").alias(c) for c in columns])


def newest_ranked(entries: DataFrame, *, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """All entries with ``age``, 1 for the newest of a key."""
    return entries.withColumn("age", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first)).cast("long"))


def archived(entries: DataFrame, *, keys: list[str], newest_first: list[Column], is_archived: Column) -> DataFrame:
    """The newest entry of each key if that is an archived one; live entries hide older archived ones."""
    return newest(entries, keys=keys, newest_first=newest_first, dead=~is_archived)
