"""Histories by ledger sequence (headers, transactions, results) as tables, read by ledger and by checkpoint.

Folders hold 65,536 ledgers each and files are in order of sequence, so a lookup opens one folder and, by the ranges in
the files' footers, few row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tallyloom.functions import ids

BLOCK = 65_536


def _block(sequence: Column) -> Column:
    return F.floor(sequence / BLOCK).cast("long")


def write(rows: DataFrame, path: str, *, sequence: str = "sequence") -> None:
    """Adds rows, which may come in any order, to the history at ``path``."""
    ordered = rows.withColumn("block", _block(F.col(sequence))).repartitionByRange(F.col(sequence)).sortWithinPartitions(sequence)
    ordered.write.mode("append").partitionBy("block").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("block", F.col("block").cast("long"))


def between(history: DataFrame, first: int, last: int, *, sequence: str = "sequence") -> DataFrame:
    """Rows of the ledgers ``first`` to ``last``; other folders are not opened."""
    s = F.col(sequence)
    return history.where(F.col("block").between(first // BLOCK, last // BLOCK) & s.between(first, last)).drop("block")


def at(history: DataFrame, ledger: int, *, sequence: str = "sequence") -> Row:
    """The header of a ledger; one that is not there is an error."""
    found = between(history, ledger, ledger, sequence=sequence).take(1)
    if not found:
        raise LookupError(f"no header of ledger {ledger}")
    return found[0]


def checkpoint(history: DataFrame, point: int, *, every: int = 64, sequence: str = "sequence") -> DataFrame:
    """All rows of a checkpoint: of the ledger that it is named after and of those since the one before."""
    if (point + 1) % every:
        raise ValueError(f"{point} is not a checkpoint")
    return between(history, point - every + 1, point, sequence=sequence)


def at_each(history: DataFrame, wanted: DataFrame, *, ledger: str, sequence: str = "sequence") -> DataFrame:
    """``wanted`` with the row of the history at its ``ledger``, nulls where there is none. Joins on the folder too, so it is pruned by what is wanted."""
    left = wanted.withColumn("__block", _block(F.col(ledger)))
    right = history.withColumnRenamed("block", "__of").withColumnRenamed(sequence, "__sequence")
    return left.join(right, (F.col("__block") == F.col("__of")) & (F.col(ledger) == F.col("__sequence")), "left").drop("__block", "__of", "__sequence")


def of_checkpoints(history: DataFrame, points: DataFrame, *, point: str, every: int = 64, sequence: str = "sequence") -> DataFrame:
    """All rows of many checkpoints, with the name of theirs in ``point``."""
    rows = history.withColumn(point, ids.next_checkpoint(F.col(sequence), every)).drop("block")
    return rows.join(points.select(point).distinct(), point)
