"""Pages by key, not by offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def page(df: DataFrame, *, key: Column, after: object = None, limit: int = 10, descending: bool = False, max_limit: int = 200, implied: Column | None = None) -> DataFrame:
    """The next ``limit`` rows after ``after`` in order of ``key``.

    The bound is a filter on the key. Where the key is computed, scans cannot use that: ``implied`` is a condition on
    stored columns that every row of the page fulfils, which they can.
    """
    if not 0 < limit <= max_limit:
        raise ValueError(f"limit must be in 1..{max_limit}")
    if implied is not None:
        df = df.where(implied)
    if after is not None:
        df = df.where(key < F.lit(after) if descending else key > F.lit(after))
    return df.orderBy(key.desc() if descending else key.asc()).limit(limit)


def slice_from(df: DataFrame, *, index: str, start: int, limit: int) -> DataFrame:
    """Rows from place ``start`` on, at most ``limit`` (0: all); past the end none."""
    if start < 0 or limit < 0:
        raise ValueError("start and limit must not be negative")
    rows = df.where(F.col(index) >= start)
    return rows.where(F.col(index) < start + limit) if limit else rows


def page_fault(*, start: Column, cursor: Column, limit: Column, oldest: Column, latest: Column, max_limit: int) -> Column:
    """Why a request for a page of ledgers is refused, null where it is not.

    It starts at a known ledger or at a cursor, not at both; null and 0, null and '' say that none is named. A limit, if
    there is one, is at most ``max_limit``.
    """
    first = F.coalesce(start, F.lit(0))
    named = F.coalesce(cursor, F.lit("")) != ""
    return F.when(named & (first != 0), "start and cursor").when(~named & ~first.between(oldest, latest), "start not known").when(limit > max_limit, "limit too high")
