import corpus_pipeline
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom.llm import registry

FOLDER = "/root/testdata/sf0.001"


def test_all_are_there():
    assert [n.split("_")[0] for n in registry.queries() if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in entry.queries() and set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(registry.queries()[name](spark, FOLDER)) == duck_rows(FOLDER, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.oracle_sql()])
def test_others_return_their_table(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() >= 100


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("text", F.when(F.col("doc_id") != 3, F.col("text")))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, FOLDER)
        assert out.schema.names == docs.schema.names
        ids = seen.select("doc_id").distinct()
        assert out.join(ids, "doc_id", "left_anti").count() == 0
        seen = spark.createDataFrame(out.collect(), out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, FOLDER)
    assert packed.select("doc_id").distinct().count() == seen.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_stages_take_empty_input(spark):
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
