"""Running sums and last values by key, also for keys that hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.sinks.scratch import written

#: A key with this many rows, and more than 1 / ``FREQUENT`` of all, is dealt to many tasks.
HOT_ROWS, FREQUENT = 1_000_000, 1000


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _same(keys: list[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for k in keys:
        name = "`" + k.replace("`", "``") + "`"
        out = out & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return out


def _plain(df: DataFrame, keys: list[Column], order: list[str], sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[_quoted(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    found = {n: F.sum(c).over(w) for n, c in sums.items()} | {n: F.last(c, ignorenulls=True).over(w) for n, c in lasts.items()}
    return df.withColumns(found)


def before(df: DataFrame, *, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, hot_rows: float | None = None) -> DataFrame:
    """``df`` with, for each row, the sum (``sums``) and the last value that is not null (``lasts``) over the rows of its key before it.

    Before the first row of a key sums are 0 and last values null. Nulls count as 0 in sums. ``order`` must tell the rows of
    a key apart; null keys are keys. Sums have the type that Spark gives them and fail rather than wrap.

    Plan: rows are counted by key (combined map-side), unless ``hot_rows`` is infinite. Without a key of ``hot_rows`` (default ``HOT_ROWS``) it is one window by key,
    which keeps one row at a time. The rows of keys that have more than 1 / ``FREQUENT`` of all rows besides, fewer than ``FREQUENT`` keys, go by ranges of the order to
    all tasks and are written with their range; sums run inside ranges, then over the totals of ranges, and are added up.
    """
    sums, lasts = sums or {}, lasts or {}
    least = HOT_ROWS if hot_rows is None else hot_rows
    hot = []
    if keys and least != float("inf"):
        counts = df.groupBy(*[_quoted(k) for k in keys]).agg(F.count("*").alias("__rows"))
        total, most = counts.agg(F.sum("__rows"), F.max("__rows")).first()
        if total and most >= least and most * FREQUENT > total:
            hot = counts.where((F.col("__rows") >= least) & (F.col("__rows") * FREQUENT > total)).collect()
    zero = {n: F.coalesce(_quoted(n), F.lit(0)) for n in sums}
    if not hot:
        return _plain(df, [_quoted(k) for k in keys], order, sums, lasts).withColumns(zero)
    few = F.broadcast(df.sparkSession.createDataFrame([tuple(r)[: len(keys)] for r in hot], df.select(*[_quoted(k) for k in keys]).schema).alias("h"))
    cold = df.alias("d").join(few, _same(keys, "d", "h"), "left_anti")
    rows = df.alias("d").join(few, _same(keys, "d", "h"), "left_semi")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.repartitionByRange(tasks, *[_quoted(c) for c in [*keys, *order]]).withColumn("__range", F.spark_partition_id()), "ranges")
    inside = _plain(rows, [*[_quoted(k) for k in keys], F.col("__range")], order, sums, lasts)
    place = F.struct(*[_quoted(o) for o in order])
    totals = rows.groupBy(*[_quoted(k) for k in keys], "__range").agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.max_by(c, F.when(c.isNotNull(), place)).alias(n) for n, c in lasts.items()])
    totals = _plain(totals, [_quoted(k) for k in keys], ["__range"], {f"__{n}": _quoted(n) for n in sums}, {f"__{n}": _quoted(n) for n in lasts})
    totals = totals.drop(*sums, *lasts).withColumnRenamed("__range", "__of")
    whole = inside.alias("d").join(totals.alias("h"), _same(keys, "d", "h") & (F.col("__range") == F.col("__of")))
    added = {n: (F.coalesce(F.col(f"d.{n}"), F.lit(0)) + F.coalesce(F.col(f"h.__{n}"), F.lit(0))) for n in sums} | {n: F.coalesce(F.col(f"d.{n}"), F.col(f"h.__{n}")) for n in lasts}
    whole = whole.select(*[F.col("d.`" + c.replace("`", "``") + "`") for c in df.columns if c not in added], *[c.alias(n) for n, c in added.items()])
    return _plain(cold, [_quoted(k) for k in keys], order, sums, lasts).withColumns(zero).select(*[_quoted(c) for c in whole.columns]).unionByName(whole)
