"""Scans of layered buckets at a checkpoint: which buckets in what order, what records they may hold, and what is left.

A record has ``hash`` (of its bucket), ``n`` (its place there, from 0), ``kind``, ``key`` and ``type`` (of the entry). The
first record of a bucket may be of kind ``meta``, with ``protocol`` and ``list_type``. A live list has ``init``, ``live``
and ``dead`` records, a list of archived entries ``archived`` and ``live`` ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.operators import snapshot

LIVE, HOT = "live", "hot_archive"
KINDS = {LIVE: ("meta", "init", "live", "dead"), HOT: ("meta", "archived", "live")}
#: Entries whose ids are never used again once they are gone.
UNIQUE = ("claimable_balance", "offer")
ZERO = "0" * 64


def listed(states: DataFrame, *, sequence: int, levels: str = "levels", every: int = 64) -> DataFrame:
    """(rank, hash) of the buckets that the state of a checkpoint names, newest first; empty slots are left out.

    ``levels`` is an array of structs with ``curr`` and ``snap``. A sequence that is no checkpoint is refused.
    """
    if (sequence + 1) % every:
        raise ValueError(f"{sequence} is not a checkpoint")
    rows = states.where(F.col("sequence") == sequence).select(F.posexplode(levels).alias("level", "b"))
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"b.{s}").alias("hash")) for s in ("curr", "snap")])
    rows = rows.select("level", F.inline(slots))
    return rows.where((F.col("hash") != "") & (F.col("hash") != ZERO)).select(snapshot.layer_rank(F.col("level"), F.col("slot")).alias("rank"), "hash")


def record_faults(records: DataFrame, *, list_kind: str) -> DataFrame:
    """(hash, n, fault) for each bucket: its first record that breaks a rule, nulls where none does.

    One aggregate by bucket with map-side combine, whatever a bucket's size.
    """
    kind, n, of_list = F.col("kind"), F.col("n"), F.col("list_type")
    meta = kind == "meta"
    fault = F.when(kind.isNull() | ~kind.isin(*KINDS[list_kind]), "unknown kind").when(meta & (n > 0), "meta not first")
    if list_kind == HOT:
        fault = fault.when(meta & of_list.isNull(), "no list named").when(~meta & (n == 0), "no meta first")
    fault = fault.when(meta & (of_list != list_kind), "bucket of another list")
    found = records.groupBy("hash").agg(
        F.min(F.when(fault.isNotNull(), F.struct(n.cast("long").alias("n"), fault.alias("fault")))).alias("first"),
        F.max(F.when(meta & (n == 0), F.col("protocol"))).alias("protocol"),
        F.min(F.when(kind == "init", n.cast("long"))).alias("init"),
    )
    early = F.when(F.col("init").isNotNull() & (F.coalesce("protocol", F.lit(0)) < 11), F.struct(F.col("init").alias("n"), F.lit("init before protocol 11").alias("fault")))
    return found.select("hash", F.least("first", early).alias("f")).select("hash", "f.n", "f.fault")


def _records(records: DataFrame, buckets: DataFrame, list_kind: str, entry_kinds: tuple[str, ...], keep_entry: Column | None, keep_key: Column | None) -> DataFrame:
    """Records of the listed buckets that the filters keep, with ``rank``; a bucket that is missing or breaks a rule is an error.

    Broadcasts the verdicts on the buckets of one list, of which there are two a level.
    """
    verdicts = buckets.join(record_faults(records, list_kind=list_kind).withColumn("__found", F.lit(True)), "hash", "left")
    said = F.when(F.col("__found").isNull(), F.concat(F.lit("no bucket "), "hash")).when(F.col("fault").isNotNull(), F.concat("fault", F.lit(" at record "), "n", F.lit(" of "), "hash"))
    rank = F.when(said.isNotNull(), F.raise_error(said).cast("int")).otherwise(F.col("rank"))
    # A generator, so that the check is made for each bucket and not left out for those without a kept record.
    checked = verdicts.select("hash", F.explode(F.array(rank)).alias("rank"))
    rows = records.join(F.broadcast(checked), "hash").where(F.col("kind") != "meta")
    is_entry = F.col("kind").isin(*entry_kinds)
    if keep_entry is not None:
        rows = rows.where(~is_entry | keep_entry)
    if keep_key is not None:
        rows = rows.where(is_entry | keep_key)
    return rows


def live_entries(records: DataFrame, buckets: DataFrame, *, keep_entry: Column | None = None, keep_key: Column | None = None) -> DataFrame:
    """The entries of a live list: records of kind ``init`` and ``live`` that no newer one of their key hides.

    Newer ``live`` and ``dead`` records hide older ones. An ``init`` record hides nothing, and where ids are unique what
    lies below it counts as seen no more. ``keep_entry`` and ``keep_key`` filter entries and dead keys; what they refuse
    hides nothing. A key has one record a bucket at most, so its window is as long as the list.
    """
    rows = _records(records, buckets, LIVE, ("init", "live"), keep_entry, keep_key)
    newer = Window.partitionBy("key").orderBy("rank", "n").rowsBetween(Window.unboundedPreceding, -1)
    kind, at = F.col("kind"), F.struct("rank", "n")
    hidden = F.max(F.when(kind != "init", at)).over(newer)
    cleared = F.max(F.when((kind == "init") & F.col("type").isin(*UNIQUE), at)).over(newer)
    rows = rows.withColumn("__hidden", hidden.isNotNull() & (cleared.isNull() | (hidden > cleared)))
    return rows.where((kind != "dead") & ~F.col("__hidden")).drop("__hidden")


def archived_entries(records: DataFrame, buckets: DataFrame, *, keep_entry: Column | None = None, keep_key: Column | None = None) -> DataFrame:
    """The entries of a list of archived ones: the newest record of each key, if it is ``archived``; ``live`` ones hide older ones."""
    rows = _records(records, buckets, HOT, ("archived",), keep_entry, keep_key)
    return snapshot.archived(rows, keys=["key"], newest_first=[F.col("rank"), F.col("n")], is_archived=F.col("kind") == "archived")
