"""Writing: upserts, range deletes and packing of ledgers into files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.ids import file_start


def upserted(old: DataFrame, new: DataFrame, *, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key, and those of new keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def without_range(df: DataFrame, *, column: str, start: int, end: int) -> DataFrame:
    """Rows whose ``column`` is not in [start, end); rows without a value stay."""
    return df.where(~F.coalesce((F.col(column) >= start) & (F.col(column) < end), F.lit(False)))


def append(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def packed_batches(ledgers: DataFrame, *, sequence: str, per_file: int) -> DataFrame:
    """Ledgers by file: (start, sequences); a file whose sequences are not contiguous is an error."""
    out = ledgers.groupBy(file_start(F.col(sequence), per_file).alias("start")).agg(F.array_sort(F.collect_set(sequence)).alias("sequences"))
    whole = F.element_at("sequences", -1) - F.element_at("sequences", 1) + 1 == F.size("sequences")
    return out.withColumn("sequences", F.when(whole, F.col("sequences")).otherwise(F.raise_error(F.lit("ledgers are not contiguous")).cast(out.schema["sequences"].dataType)))


def split_by_type(state: DataFrame, types: list[str], *, column: str = "type") -> list[DataFrame]:
    """A state's rows of each type, as dumps that are written apart; other types are in none."""
    return [state.where(F.col(column) == kind) for kind in types]
