"""Structured Streaming forms: windows over event time, ordered batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions.timing import epoch_ms


def file_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the Parquet files at a path, with the schema that they have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.parquet(f"{folder}/{{{name}}}")  # as a pattern, so that it may be a single file


def windowed_counts(events: DataFrame, *, time: str, keys: list[str], length: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Counts by key and window of event time, a timestamp without a zone taken as UTC; events later than the watermark are dropped."""
    timed = events.withColumn("__t", F.timestamp_millis(epoch_ms(F.col(time)))).withWatermark("__t", watermark)
    return timed.groupBy(F.window("__t", length, slide), *keys).agg(F.count("*").alias("n"))


def run_into(df: DataFrame, handle: Callable[[DataFrame, int], None], *, mode: str, checkpoint: str) -> None:
    """Runs a stream over all that is there now; ``handle`` takes each batch, as ``foreachBatch`` does."""
    df.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replaced_table(path: str) -> Callable[[DataFrame, int], None]:
    """For streams in complete mode: each batch, which holds the whole result, is a version of the table below ``path``."""

    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return batch


def last_version(spark: SparkSession, path: str) -> DataFrame:
    versions = spark.read.parquet(path)
    newest = versions.select(F.max("version")).first()[0]
    return versions.where(F.col("version").eqNullSafe(F.lit(newest))).drop("version")


def _done(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, int] | None:
    """The last batch that is whole (below ``before``) and its last sequence."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    marks = spark.read.schema("high long, batch long").parquet(f"{path}/done")
    marks = marks if before is None else marks.where(F.col("batch") < before)
    row = marks.select(F.max(F.struct("batch", "high")).alias("m")).first()["m"]
    return None if row is None else (row["batch"], row["high"])


def ordered_table(path: str, *, sequence: str, first: str | None = None, shape: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends batches of whole ledgers to a table, and refuses those that do not come after what is there.

    ``path`` is a folder that driver and executors share, one a stream. What has come so far is read from it, so a stream
    that stops and goes on from its checkpoint refuses what it would have refused before. A batch that runs again writes
    over its own rows; its mark is written after them, and ``ordered_rows`` reads marked batches alone. Batches without
    rows leave nothing; rows without a sequence are an error, as they have no place in the order. Rows that sum up several
    ledgers have the earliest of them in ``first``. ``shape`` is applied to
    a batch before it is written, for instance compaction by ledger and key, which is whole as no ledger comes twice.
    """

    def put(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        low, high, n, known = df.agg(F.min(first or sequence).cast("long"), F.max(sequence).cast("long"), F.count("*"), F.count(sequence)).first()
        if n == 0:
            return
        if known < n:
            raise ValueError(f"batch {batch_id} has rows without a sequence")
        last = _done(spark, path, batch_id)
        if last is not None and low <= last[1]:
            raise ValueError(f"batch {batch_id} goes back from {last[1]} to {low}")
        (df if shape is None else shape(df)).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        spark.range(1).select(F.lit(high).cast("long").alias("high")).write.mode("overwrite").parquet(f"{path}/done/batch={batch_id}")

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()  # it is looked at before it is written, and state is to change once
        try:
            put(df, batch_id)
        finally:
            df.unpersist()

    return batch


def ordered_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all whole batches of an ``ordered_table``, with their ``batch``; an error where there are none yet."""
    last = _done(spark, path)
    if last is None:
        raise ValueError(f"no batch has come to {path}")
    return spark.read.parquet(f"{path}/rows").where(F.col("batch") <= last[0])
