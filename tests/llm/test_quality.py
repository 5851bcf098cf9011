import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import quality as q

FOLDER = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_held_out_labels(spark):
    docs, labels = tables(spark)
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    model = q.fit_quality(docs, labels, usable=third != 1)
    rows = q.scored(docs.withColumn("score", F.lit("old")), model).join(labels, "doc_id").where(third == 1).collect()
    assert len(rows) > 80 and np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_only_the_text_counts_and_runs_agree(spark):
    docs, labels = tables(spark)
    few = labels.where("doc_id < 600")
    model = q.fit_quality(docs, few, sample=150)
    other = docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"), "n_chars").repartition(5)
    a = {r.doc_id: r.score for r in q.scored(docs, model).collect()}
    b = {r.doc_id - 10**6: r.score for r in q.scored(other, q.fit_quality(docs.repartition(3), few, sample=150)).collect()}
    assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-3 for k in a)


def test_odd_rows(spark):
    docs, labels = tables(spark)
    model = q.fit_quality(docs, labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (10**9, 0, 0), (2, 7, 0)], labels.schema)))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, " \n"), (3, "x" * 200_000), (4, "é " * 50_000)], "doc_id long, text string")
    scores = [r.score for r in q.scored(odd, model).collect()]
    assert len(scores) == 5 and all(np.isfinite(scores)) and scores[0] == scores[1] == scores[2]
    assert q.scored(odd.where("false"), model).count() == 0


def test_one_class_or_none(spark):
    docs, labels = tables(spark)
    for rows, want in ((labels.where("false"), 1), (labels.where("quality = 1"), 1), (labels.where("quality = 0"), 0)):
        scores = [r.score for r in q.scored(docs.where("doc_id < 20"), q.fit_quality(docs, rows)).collect()]
        assert all(round(s) == want for s in scores)


def test_temperature_undoes_overconfidence():
    rng = np.random.default_rng(1)
    z = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    assert 2.5 < q.fit_temperature(3 * z, y) < 3.6


def test_the_sample_is_ordered_in_place():
    import tracemalloc

    import pyarrow as pa

    x = np.random.default_rng(5).normal(0, 1, (6000, 2 * q.DIMS + 1)).astype(np.float32)
    docs = np.random.default_rng(6).integers(0, 5000, 6000)
    table = pa.table({"doc": docs, "y": pa.array(docs % 2, pa.int32()), "x": pa.array([v.tobytes() for v in x], pa.binary())})
    want = sorted(range(6000), key=lambda k: (docs[k], x[k].tobytes()))
    tracemalloc.start()
    y, got = q._in_order(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == x[want]).all() and (y == docs[want] % 2).all() and got.dtype == np.float64
    assert peak < 2.2 * got.nbytes  # not an object a row
    assert [len(v) for v in q._in_order(table.slice(0, 0))] == [0, 0]
