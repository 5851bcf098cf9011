import os
import threading

import pytest

from tallyloom.sinks import objects

SCHEMA = "path string, content binary"


def tree(folder):
    return {os.path.relpath(f"{d}/{n}", folder): open(f"{d}/{n}", "rb").read() for d, _, names in os.walk(folder) for n in names}


def frame(spark, rows):
    return spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], SCHEMA).repartition(3)


def test_objects_are_put_once(spark, tmp_path):
    folder = f"file://{tmp_path}/o"
    got = objects.put_if_absent(frame(spark, [("a/b/1", b"one"), ("2", b""), ("3", None), (None, b"x")]), folder).collect()
    assert sorted(map(tuple, got)) == [("2", 0, True), ("3", 0, True), ("a/b/1", 3, True)]
    got = objects.put_if_absent(frame(spark, [("a/b/1", b"other"), ("4", b"four")]), folder).collect()
    assert sorted(map(tuple, got)) == [("4", 4, True), ("a/b/1", 0, False)]
    assert tree(f"{tmp_path}/o") == {"a/b/1": b"one", "2": b"", "3": b"", "4": b"four"}


def test_of_two_writers_one_wins_and_nothing_is_half_written(spark, tmp_path):
    folder, found = f"file://{tmp_path}/o", []
    big = [[(f"n{i}", bytes([65 + who]) * 300_000) for i in range(30)] for who in range(3)]

    def put(rows):
        found.extend(objects.put_if_absent(frame(spark, rows), folder).collect())

    writers = [threading.Thread(target=put, args=(rows,)) for rows in big]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    held = tree(f"{tmp_path}/o")
    assert set(held) == {f"n{i}" for i in range(30)} and all(len(c) == 300_000 and len(set(c)) == 1 for c in held.values())
    assert sorted(r.path for r in found if r.created) == sorted(held)


def test_rows_twice_in_one_write(spark, tmp_path):
    got = objects.put_if_absent(frame(spark, [("same", b"x")] * 20), f"file://{tmp_path}/o").collect()
    assert sum(r.created for r in got) == 1 and tree(f"{tmp_path}/o") == {"same": b"x"}


def test_a_mirror_ends_equal_to_its_source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(objects, "PIECE", 1000)
    source, target = f"file://{tmp_path}/s", f"file://{tmp_path}/t"
    rows = [(f"d{i % 3}/f{i}.gz", bytes([i]) * (i * 700)) for i in range(12)]
    objects.put_if_absent(frame(spark, rows), source).collect()
    objects.put_if_absent(frame(spark, rows[:4] + [("own", b"kept")]), target).collect()
    copied = objects.mirrored(spark, source, target).collect()
    assert sorted((r.path, r.bytes, r.created) for r in copied) == sorted((p, len(c), True) for p, c in rows[4:])
    assert tree(f"{tmp_path}/t") == dict(rows) | {"own": b"kept"}
    assert objects.mirrored(spark, source, target).collect() == []


def test_stores_that_cannot_promise_it(tmp_path):
    with pytest.raises(ValueError, match="cannot create a name"):
        objects._store("mock:///x")
