"""Instants as milliseconds, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without a zone."""
    parts = F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000
    return F.unix_date(F.to_date(ts)).cast("long") * 86_400_000 + parts + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def round_down(ms: Column, step: int, offset: int = 0) -> Column:
    """The start of the bucket [start, start + step) that ``ms`` is in; buckets begin at ``offset``."""
    return F.floor((ms - offset) / step).cast("long") * step + offset


def round_up(ms: Column, step: int) -> Column:
    return F.ceil(ms / step).cast("long") * step
