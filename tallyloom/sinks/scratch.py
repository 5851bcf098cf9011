"""Where intermediate results are written so that a lost executor costs no more than a re-read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: str | None = None
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (single-machine tests), one of our own."""
    global _fallback
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _fallback is None:
        _fallback = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
    return _fallback


def shared_path(spark: SparkSession, tag: str) -> str:
    _made.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Deletes what this process has put into the shared folder; frames that still read it fail from then on."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Has the driver forget frames that nobody holds any more, and with them their shuffles and broadcasts, on executors too.

    Spark drops these when the driver's JVM collects garbage, by itself every half hour; loops of many small jobs call
    this after each round, so what the driver holds does not depend on the number of rounds.
    """
    spark._jvm.System.gc()


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once and its lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
