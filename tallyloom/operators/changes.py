"""Keyed change streams: order, pairing of states, and compaction to one change a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.operators.running import before

CREATED, UPDATED, REMOVED, RESTORED, ERROR = "created", "updated", "removed", "restored", "error"


def change_order(df: DataFrame, *, ledger: str = "ledger", stage: str = "stage", phase: str = "phase", parallel: str = "parallel", tx: str = "tx_index", op: str = "op_index", part: str = "part", key: str = "key", ord_: str = "ord", out: str = "place") -> DataFrame:
    """``df`` with ``out``: each change's place, from 1, in the order in which a ledger applies its changes.

    Fees come first, then the transactions by phase, then what follows them, then upgrades (``stage`` 0 to 3). In a
    parallel phase, operations' changes and what comes after them (``part`` 1 and 2) wait until every transaction of the
    phase has had what comes before (``part`` 0). Within a group, changes are in order of their key's bytes, then of arrival.
    """
    waits = F.when(F.coalesce(F.col(parallel), F.lit(False)) & (F.col(part) > 0), F.lit(1)).otherwise(F.lit(0))
    order = [F.coalesce(F.col(phase), F.lit(0)), waits, F.coalesce(F.col(tx), F.lit(0)), F.col(part), F.coalesce(F.col(op), F.lit(0)), F.col(key), F.col(ord_)]
    return df.withColumn(out, F.row_number().over(Window.partitionBy(ledger).orderBy(stage, *order)).cast("long"))


def paired(states: DataFrame, *, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``states`` with ``pre`` and ``post``: the value before, by ``keys``, and the row's own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return states.withColumn("pre", F.lag(value).over(w)).withColumn("post", F.col(value))


def state_pairs(entries: DataFrame, *, keys: list[str], order: list[str], kind: str = "kind", value: str = "value", state: str = "state") -> DataFrame:
    """Changes out of a log in which a ``state`` entry may stand before the change that it is the state before: (keys, place, kind, pre, post).

    ``pre`` is the value of a state entry right before, else null; removals have no ``post``; ``place`` counts the changes of a key from 0.
    Two windows of one sort, each of a row and the one before or of a count, so no key's entries are gathered.
    """
    c = F.col
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = entries.select(*dict.fromkeys([*keys, *order]), c(kind).alias("kind"), F.when(F.lag(kind).over(w) == state, F.lag(value).over(w)).alias("pre"), F.when(c(kind) != REMOVED, c(value)).alias("post"), F.count_if(c(kind) != state).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("place"))
    return rows.where(c("kind") != state).select(*keys, F.coalesce("place", F.lit(0)).cast("long").alias("place"), "kind", "pre", "post")


def compacted(changes: DataFrame, *, keys: list[str], order: list[str], kind: str = "kind", pre: str = "pre", post: str = "post", suppress_remove_after_restore: bool = True, longest: bool | str = False, on_error: str = "raise", hot_rows: int | None = None) -> DataFrame:
    """One change a key (``kind``, ``pre``, ``post``) that does what all of them did in order.

    Created then updated stays created; updated merges; created then removed leaves nothing, so the key starts afresh;
    updated then removed is removed from the first pre; removed then created is updated; restored then updated stays
    restored; restored then removed leaves nothing, or with ``suppress_remove_after_restore`` off is removed from its
    own pre. Any other step, and any other kind, is not allowed: ``on_error`` "raise" fails, "mark" returns the kind ``error``.
    With ``longest`` the greater post wins an update (times to live), by itself or by the field of that name; of equal ones
    the later. ``pre`` and ``post`` are values of any one type, structs of whole entries for instance. ``order`` must tell the
    changes of a key apart. Other columns are not returned. Empty input: empty output.

    How a key's changes fold follows from a few numbers that need no fold: count what is made (+1) and removed (-1) before
    each change. A key whose changes pair up makes and removes things of its own, and nothing but the last open one counts.
    The first change to something that was not made here (an update or removal at 0; with ``suppress_remove_after_restore`` off also
    the removal of what was restored) says that the key was there before; from then on it can only be updated, or removed
    and made again. The places of that change, of the last opening and of steps that do not fit are least and greatest
    values, so the changes of a key are combined map-side and never gathered; the counts before are running sums.
    """
    c = F.col
    at = F.struct(*[c(o) for o in order])
    fields = changes.select(*dict.fromkeys([*keys, *order]), c(kind).alias("__kind"), c(pre).alias("__pre"), c(post).alias("__post"))
    opens, closes, alters = c("__kind").isin(CREATED, RESTORED), c("__kind") == REMOVED, c("__kind").isin(UPDATED, REMOVED)
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    turns = F.when(opens | closes, 1).otherwise(0)
    lasts = {} if suppress_remove_after_restore else {"__opener": F.when(opens, c("__kind"))}
    rows = before(fields, keys=keys, order=order, sums={"__made": step, "__epoch": turns}, lasts=lasts, hot_rows=hot_rows)
    made = c("__made")
    ends_restored = F.lit(False) if suppress_remove_after_restore else closes & (made == 1) & F.coalesce(c("__opener") == RESTORED, F.lit(False))
    known = alters & (made == 0)  # the key was there before
    misfit = lambda here: (alters & (made != here)) | ((c("__kind") == CREATED) & (made != here - 1)) | (c("__kind") == RESTORED)
    later = c("__post") if longest in (True, False) else c("__post")[longest]
    epoch = c("__epoch") + turns
    rank = F.struct(epoch, later, at) if longest else at
    strange = F.coalesce(~(opens | alters), F.lit(True))
    one = rows.groupBy(*keys).agg(
        F.min(F.when(known, at)).alias("known"),
        F.min(F.when(ends_restored, at)).alias("ended"),
        F.min_by("__pre", F.when(known | ends_restored, at)).alias("first_pre"),
        F.min(F.when(opens & (made != 0), at)).alias("opened_twice"),
        F.max(F.when(misfit(0), at)).alias("misfit"),
        F.max(F.when(misfit(1), at)).alias("misfit_ended"),
        F.max(F.when(opens, at)).alias("opened"),
        F.max_by("__kind", F.when(opens, at)).alias("opener"),
        F.max_by("__pre", F.when(opens, at)).alias("own_pre"),
        F.max_by("__post", rank).alias("last_post"),
        F.sum(step).alias("left"),
        F.bool_or(strange).alias("strange"),
    )
    start = F.least("known", "ended")  # nulls do not count
    by_end = c("ended").isNotNull() & (c("known").isNull() | (c("ended") < c("known")))
    wrong = c("strange") | (c("opened_twice").isNotNull() & (start.isNull() | (c("opened_twice") < start)))
    wrong = wrong | F.coalesce(F.when(by_end, c("misfit_ended") > start).otherwise(c("misfit") > start), F.lit(False))
    there = c("left") + F.when(start.isNull() | by_end, 0).otherwise(1) == 1
    found = F.when(wrong, ERROR).when(start.isNull(), F.when(there, c("opener"))).otherwise(F.when(there, UPDATED).otherwise(REMOVED))
    out = one.select(*keys, found.alias("kind"), F.when(start.isNull(), c("own_pre")).otherwise(c("first_pre")).alias("pre"), F.when(there, c("last_post")).alias("post")).where("kind is not null")
    fine = c("kind") != ERROR
    out = out.select(*keys, "kind", F.when(fine, c("pre")).alias("pre"), F.when(fine, c("post")).alias("post"))
    if on_error == "raise":
        out = out.withColumn("kind", F.when(~fine, F.raise_error(F.concat(F.lit("change not allowed for key "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys])))).otherwise(F.col("kind")))
    return out


def changed_except(df: DataFrame, pre: list[str], post: list[str]) -> Column:
    """Do the two states differ in any of the paired columns? A missing state differs from one that is there."""
    return ~F.struct(*[F.col(c) for c in pre]).eqNullSafe(F.struct(*[F.col(c) for c in post]))


def unknown_keys(changes: DataFrame, snapshot: DataFrame, *, key: str, order: list[str], pre: str = "pre", post: str = "post", hot_rows: int | None = None) -> DataFrame:
    """The changes whose state before is not accounted for: they have a ``pre``, but their key is not there by then.

    A log is replayed from a ``snapshot`` of keys: a key is there if the snapshot has it and it was not removed since, or if a
    change before gave it a ``post``. ``order`` must tell the changes of a key apart. A change that is at fault makes its key
    known by its own ``post`` from then on, as a replay would. Keys that are null are keys. Empty input: empty output.

    The last change before says whether the key is there, a running last value by key; the snapshot answers only for
    first changes, so it is joined with one row a key.
    """
    c = F.col
    rows = before(changes, keys=[key], order=order, lasts={"__there": F.when(c(post).isNotNull(), F.lit(True)).otherwise(F.lit(False))}, hot_rows=hot_rows)
    rows = rows.where(c(pre).isNotNull() & ~F.coalesce("__there", F.lit(False)))
    had = snapshot.select(c(key).alias("__key")).distinct()
    first = rows.where(c("__there").isNull()).drop("__there").join(had, c(key).eqNullSafe(c("__key")), "left_anti")
    return rows.where(~c("__there")).drop("__there").unionByName(first)
