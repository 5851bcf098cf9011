import pytest
from pyspark.sql import functions as F

from tallyloom.streaming import ledger_stream as ls


def files(spark, tmp_path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "user long, ts timestamp_ntz, seq long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i}.parquet"))
    return str(tmp_path / "in")


def test_windows_over_a_stream_equal_the_batch(spark, tmp_path):
    import datetime as d

    at = lambda h: d.datetime(2024, 1, 1) + d.timedelta(hours=h)
    folder = files(spark, tmp_path, [[(1, at(0), 1, "a"), (1, at(1), 2, "b")], [(2, at(30), 3, "c")]])
    batch = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    stream = spark.readStream.schema(batch.schema).option("recursiveFileLookup", "true").parquet(folder)
    ls.run_into(ls.windowed_counts(stream, time="ts", keys=["user"], length="1 day"), ls.replaced_table(str(tmp_path / "win")), mode="complete", checkpoint=str(tmp_path / "cp"))
    got = sorted((r.user, r.n) for r in ls.last_version(spark, str(tmp_path / "win")).collect())
    assert got == [(1, 2), (2, 1)]


def changes_stream(spark, folder):
    schema = spark.read.option("recursiveFileLookup", "true").parquet(folder).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def test_an_ordered_table_goes_on_after_a_stop(spark, tmp_path):
    import datetime as d

    now = d.datetime(2024, 1, 1)
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "cp")

    def run(folder):  # a new function each time, as after a restart: nothing is remembered but what is in the two folders
        ls.run_into(changes_stream(spark, folder), ls.ordered_table(table, sequence="seq"), mode="append", checkpoint=checkpoint)

    with pytest.raises(ValueError, match="no batch"):
        ls.ordered_rows(spark, table)
    folder = files(spark, tmp_path, [[(1, now, 1, "a"), (2, now, 1, "b")]])
    run(folder)
    spark.createDataFrame([(1, now, 2, "c")], "user long, ts timestamp_ntz, seq long, v string").coalesce(1).write.parquet(f"{folder}/later.parquet")
    run(folder)
    run(folder)
    assert sorted((r.user, r.seq, r.v, r.batch) for r in ls.ordered_rows(spark, table).collect()) == [(1, 1, "a", 0), (1, 2, "c", 1), (2, 1, "b", 0)]
    spark.createDataFrame([(1, now, 2, "again")], "user long, ts timestamp_ntz, seq long, v string").coalesce(1).write.parquet(f"{folder}/old.parquet")
    with pytest.raises(Exception, match="goes back from 2 to 2"):
        run(folder)
    assert ls.ordered_rows(spark, table).count() == 3


def test_an_ordered_table_takes_a_batch_again(spark, tmp_path):
    table = str(tmp_path / "t")
    put = lambda rows, i: ls.ordered_table(table, sequence="seq", shape=lambda df: df.groupBy("seq").agg(F.sum("x").alias("x")))(spark.createDataFrame(rows, "seq long, x long"), i)
    put([(1, 1), (1, 2)], 0)
    put([], 1)
    spark.createDataFrame([(2, 99)], "seq long, x long").write.parquet(f"{table}/rows/batch=2")  # a batch that was lost before its mark
    assert [tuple(r) for r in ls.ordered_rows(spark, table).collect()] == [(1, 3, 0)]
    put([(2, 4), (3, 5)], 2)
    put([(2, 4), (3, 5)], 2)
    assert sorted(tuple(r) for r in ls.ordered_rows(spark, table).collect()) == [(1, 3, 0), (2, 4, 2), (3, 5, 2)]
    with pytest.raises(ValueError, match="without a sequence"):
        put([(None, 1)], 3)
