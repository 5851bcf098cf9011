"""An order book with pools as keyed state of a stream: RocksDB maps by pair, changed by what a batch brings and read without a replay."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyloom.streaming.ledger_stream import ordered_table, run_into

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "selling string, buying string, part int, n long, d long, offers long, amount decimal(38,0), reserve_a long, reserve_b long, first_ledger long, ledger long"
_NAMES = [x.split()[0] for x in CHANGES.split(", ")]


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Book(StatefulProcessor):
    """Of one pair (and part of its ids): offers by id, what each price holds, the pool, and the last ledger."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.offers = handle.getMapState("offers", "id long", "amount long, n long, d long")
        self.levels = handle.getMapState("levels", "n long, d long", "offers long, amount decimal(38,0)")
        self.pool = handle.getValueState("pool", "reserve_a long, reserve_b long")
        self.last = handle.getValueState("last", "ledger long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = first = high = None
        for some in rows:
            if some["ledger"].isna().any():
                raise ValueError(f"a row of {key[0]}, {key[1]} without a ledger")
            if len(some):
                low, top = int(some["ledger"].min()), int(some["ledger"].max())
                first, high = (low, top) if first is None else (min(first, low), max(high, top))
                some = some if newest is None else pd.concat([newest, some])
                newest = some.sort_values(["ledger", "place"], kind="stable").drop_duplicates("at", keep="last")
        if first is None:
            return
        fresh = not self.last.exists()  # then nothing is held, and nothing need be looked for
        last = None if fresh else self.last.get()
        if last is not None and first <= last[0]:
            raise ValueError(f"ledger {first} of {key[0]}, {key[1]} comes after {last[0]}")
        self.last.update((high,))
        changes: list[tuple] = []
        touched: dict[tuple[int, int], list] = {}

        def level(n: int, d: int) -> list:
            g = gcd(n, d) or 1
            at = (n // g, d // g)
            if at not in touched:
                held = self.levels.getValue(at) if not fresh and self.levels.containsKey(at) else None
                touched[at] = list(held) if held else [0, Decimal(0)]
            return touched[at]

        for removed, text in zip(newest["removed"].tolist(), newest["numbers"].tolist(), strict=True):
            what, *numbers = text.split(",")
            numbers = [int(x) if x else None for x in numbers]
            if what == "pool":
                if removed:
                    self.pool.clear()
                else:
                    self.pool.update(tuple(numbers))
                changes.append((*key, None, None, None, None, *((None, None) if removed else numbers), first, high))
                continue
            id_, new_amount, new_n, new_d = numbers
            if not fresh and self.offers.containsKey((id_,)):
                amount, n, d = self.offers.getValue((id_,))
                held = level(n, d)
                held[0], held[1] = held[0] - 1, held[1] - amount
                if removed:
                    self.offers.removeKey((id_,))
            if not removed:
                self.offers.updateValue((id_,), (new_amount, new_n, new_d))
                held = level(new_n, new_d)
                held[0], held[1] = held[0] + 1, held[1] + new_amount
        for at, (count, amount) in touched.items():
            if count:
                self.levels.updateValue(at, (count, amount))
            elif not fresh and self.levels.containsKey(at):
                self.levels.removeKey(at)
            changes.append((*key, *at, count, amount, None, None, first, high))
        yield pd.DataFrame(changes, columns=_NAMES, dtype=object)

    def close(self) -> None:
        pass


def book_changes(stream: DataFrame, *, parts: int = 8) -> DataFrame:
    """What each batch changes in the book, as rows of ``CHANGES``: touched price levels with what they hold now, and pools.

    ``stream`` has (ledger, place, what, removed, selling, buying, id, amount, n, d, reserve_a, reserve_b). ``what`` is ``offer`` or ``pool``;
    an offer replaces the one with its id, a pool the one of its pair; ``removed`` ones go (what is not there is no
    error). Of rows for one id in a batch the last by (ledger, place) counts. An offer that moves to another pair comes
    as a removal there and an offer here. Ledgers must rise from batch to batch: a row that does not come after what its
    pair has seen ends the stream with an error, and ``run_book`` checks this for all pairs together.

    Of a batch's rows the newest by id are found in whole Arrow batches, and a key without state looks for none.
    State is kept by pair and ``parts`` of the ids, so a pair that many offers trade is not one key; each batch costs what it
    changes, however large the book. Removed offers leave the state. Start within ``rocksdb``.
    """
    part = F.when(F.col("what") == "offer", F.pmod(F.xxhash64("id"), F.lit(parts))).otherwise(0).cast("int")
    c = F.col
    # Numbers go as one text, as pandas would turn longs with nulls into doubles.
    text = lambda *names: F.concat(*[x for n in names for x in (F.lit(","), F.coalesce(c(n).cast("string"), F.lit("")))])
    is_offer: Column = c("what") == "offer"
    numbers = F.when(is_offer, F.concat("what", text("id", "amount", "n", "d"))).otherwise(F.concat("what", text("reserve_a", "reserve_b")))
    at = F.when(is_offer, F.coalesce(c("id").cast("string"), F.lit("none"))).otherwise(c("what"))
    place = F.coalesce(c("place").cast("long"), F.lit(-(1 << 63)))
    rows = stream.select("selling", "buying", part.alias("part"), c("ledger").cast("long").alias("ledger"), place.alias("place"), F.coalesce("removed", F.lit(False)).alias("removed"), at.alias("at"), numbers.alias("numbers"))
    return rows.groupBy("selling", "buying", "part").transformWithStateInPandas(_Book(), CHANGES, "append", "none")


def run_book(stream: DataFrame, *, path: str, checkpoint: str, parts: int = 8) -> None:
    """Applies all that is there now: changes go to the ordered table at ``path``, the book is the state below ``checkpoint``."""
    with rocksdb(stream.sparkSession):
        run_into(book_changes(stream, parts=parts), ordered_table(path, sequence="ledger", first="first_ledger"), mode="append", checkpoint=checkpoint)


def _state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    with rocksdb(spark):
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()


def book_levels(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The book as it is: (selling, buying, n, d, offers, amount) of each price in lowest terms, read from the state."""
    rows = _state(spark, checkpoint, "levels").select("key.selling", "key.buying", "user_map_key.n", "user_map_key.d", "user_map_value.offers", "user_map_value.amount")
    return rows.groupBy("selling", "buying", "n", "d").agg(F.sum("offers").alias("offers"), F.sum("amount").cast("decimal(38,0)").alias("amount"))


def book_offers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The offers of the book as it is: (selling, buying, id, amount, n, d)."""
    return _state(spark, checkpoint, "offers").select("key.selling", "key.buying", "user_map_key.id", "user_map_value.amount", "user_map_value.n", "user_map_value.d")


def book_pools(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The pools of the book as it is: (selling, buying, reserve_a, reserve_b), as they came."""
    return _state(spark, checkpoint, "pool").select("key.selling", "key.buying", "value.reserve_a", "value.reserve_b")
