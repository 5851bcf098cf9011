"""Mixing of rows that ids do not tell apart, and of tables with more sources than are broadcast."""

import collections

import pytest

from tallyloom.llm import mixing


def met(rows, slack):
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    return all(abs(taken[s] - target[s]) <= slack for s in target)


@pytest.mark.parametrize("ids", ["one", "none", "few"])
def test_rows_that_share_an_id_spread(spark, ids):
    pick = {"one": lambda i: 7, "none": lambda i: None, "few": lambda i: i % 3}[ids]
    df = spark.createDataFrame([(pick(i), "one two three four", "a" if i % 4 else "b") for i in range(200)], "doc_id long, text string, source string").repartition(4)
    got = mixing.mixed(df).collect()
    assert len(got) == 200 and met(got, 4)
    out = mixing.mixed_documents(df)
    assert out.count() == sum(r.copies for r in got)
    again = mixing.mixed(df.repartition(3)).collect()
    key = lambda rows: sorted((str(r.doc_id), r.source, r.copies) for r in rows)
    assert key(got) == key(again)


def test_many_sources_are_salted(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (1 + i % 40), [None, "a", "b", "c"][i % 4]) for i in range(400)], "doc_id long, text string, source string")
    few = sorted((r.doc_id, r.copies, round(r.target, 6)) for r in mixing.mixed(df).collect())
    monkeypatch.setattr(mixing, "FEW_SOURCES", 2)
    many = sorted((r.doc_id, r.copies, round(r.target, 6)) for r in mixing.mixed(df).collect())
    assert len(many) == 400 and sum(a != b for a, b in zip(few, many, strict=True)) <= 8


def test_clashing_names(spark):
    names = ["row", "copies", "copy", "__id", "__from", "__copies", "a.b", "id", "size", "target", "_row"]
    df = spark.createDataFrame([(i, "one two three", "s", *range(11)) for i in range(10)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))
    out = mixing.mixed_documents(df, share=1.5)
    assert out.columns == df.columns and out.count() == 15 and {tuple(r)[3:] for r in out.collect()} == {tuple(range(11))}
    assert mixing.mixed(df).count() == 10


def test_ids_of_a_dotted_name(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "`doc.id` long, text string, source string")
    assert mixing.mixed(df, id_col="doc.id").columns[0] == "doc.id"


def test_rounds_are_few_small_jobs(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 37 as int)) as text", "concat('s', id % 4) as source")
    spark.sparkContext.setJobGroup("mix", "what the driver holds grows with jobs")
    try:
        assert mixing.mixed(docs).count() == 400
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("mix"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 105  # 115 when each round wrote its moves, rows and rests by themselves
