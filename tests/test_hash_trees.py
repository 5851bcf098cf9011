import hashlib

from pyspark.sql import functions as F

from tallyloom.operators import changes, hash_trees as ht

C = F.col


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_bucket_lists(spark):
    a, b = sha(b"a"), sha(b"b")
    levels = [(a, b), ("", b), (None, None), (a.upper(), "")]
    rows = [(levels,), ([("ab", b)],), ([("x" * 64, b)],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "levels array<struct<curr:string,snap:string>>").select(ht.bucket_list_hash(C("levels"))).collect()]
    each = b"".join(hashlib.sha256(bytes.fromhex((x or "") + (y or ""))).digest() for x, y in levels)
    assert got == [sha(each), None, None, sha(b""), None]


def test_fixed_digests():
    assert ht.EMPTY_RESULTS == sha(b"\0" * 4)


HEADERS = "sequence long, content binary, hash string, prev_hash string, set_hash string, result_hash string"


def chain(n):
    """Headers 5, 6, ...: the sets of the first three are empty, each in another form."""
    out, previous = [], sha(b"before")
    for i in range(n):
        content = b"header %d %s" % (5 + i, previous.encode())
        prev = bytes.fromhex(previous)
        empty = [prev, b"\0\0\0\1" + prev + b"\0\0\0\2" + b"\0" * 16, b"\0\0\0\1" + prev + b"\0\0\0\2" + b"\0" * 8 + b"\0\0\0\1" + b"\0" * 8]
        envelopes = sorted([b"tx %d %d" % (i, k) for k in range(4)], key=lambda e: hashlib.sha256(e).digest())
        named = sha(empty[i]) if i < 3 else sha(prev + b"".join(envelopes))
        out.append((5 + i, bytearray(content), sha(content), previous, named, sha(b"\0" * 4) if i < 3 else sha(b"results %d" % i)))
        previous = sha(content)
    return out


def parts(spark, n=8):
    rows = chain(n)
    envelopes = spark.createDataFrame([(5 + i, bytearray(b"tx %d %d" % (i, k))) for i in range(3, n) for k in range(4)], "sequence long, body binary").repartition(3)
    results = spark.createDataFrame([(5 + i, sha(b"results %d" % i)) for i in range(3, n)], "sequence long, hash string")
    return rows, envelopes, results


def test_a_sound_archive_has_no_report(spark):
    rows, envelopes, results = parts(spark)
    headers = spark.createDataFrame(rows, HEADERS)
    assert ht.hash_report(headers, ht.set_hashes(envelopes, headers), results).collect() == []
    empty = spark.createDataFrame([], HEADERS)
    assert ht.hash_report(empty, ht.set_hashes(envelopes, empty), results).collect() == []


def test_one_changed_byte_is_found(spark):
    rows, envelopes, results = parts(spark)
    headers = spark.createDataFrame(rows, HEADERS)
    flipped = F.when(C("body") == F.lit(b"tx 4 2"), F.lit(b"tx 4 3?")).otherwise(C("body"))
    report = ht.hash_report(headers, ht.set_hashes(envelopes.withColumn("body", flipped), headers), results).collect()
    assert [(r.what, r.sequence, r.expected) for r in report] == [("transaction set", 9, rows[4][4])]
    broken = [*rows]
    broken[4] = (9, bytearray(b"other"), *rows[4][2:])
    report = ht.hash_report(spark.createDataFrame(broken, HEADERS), ht.set_hashes(envelopes, headers), results).collect()
    assert sorted((r.what, r.sequence, r.expected, r.actual) for r in report) == [("header content", 9, rows[4][2], sha(b"other")), ("ledger header", 9, rows[4][2], sha(b"other"))]


def test_what_is_missing(spark):
    rows, envelopes, results = parts(spark)
    headers = spark.createDataFrame(rows, HEADERS)
    gone = headers.where("sequence <> 8")
    report = ht.hash_report(gone, ht.set_hashes(envelopes.where("sequence <> 10"), headers), results.where("sequence <> 11")).collect()
    assert sorted((r.what, r.sequence, r.actual) for r in report) == [("ledger header", 8, None), ("result set", 11, None), ("transaction set", 10, None)]


def test_buckets(spark):
    names = [sha(b"a"), sha(b"b"), sha(b"c"), sha(b"d")]
    refs = spark.createDataFrame([(n,) for n in [*names, names[0], "", None, "0" * 64]], "hash string")
    found = spark.createDataFrame([(names[0], bytearray(b"a")), (names[1], bytearray(b"B")), (names[3], None), ("unreferenced", bytearray(b"x"))], "hash string, content binary")
    got = {r.hash: r.verdict for r in ht.bucket_report(refs, found).collect()}
    assert got == dict(zip(names, ["ok", "invalid", "missing", "invalid"], strict=True))


def test_replay_of_a_log(spark):
    log = [("a", 1, 5, 6), ("a", 2, 6, None), ("a", 3, None, 7), ("a", 4, 7, 8), ("b", 1, 1, 2), ("b", 2, 2, None), ("b", 3, 2, 3), ("b", 4, 3, 4), ("c", 1, None, 1), ("c", 2, 1, 2), (None, 1, 1, 1), ("d", 1, 1, None)]
    rows = spark.createDataFrame(log, "key string, i int, pre int, post int").withColumn("a.b", F.lit(1))
    snapshot = spark.createDataFrame([("a",), ("a",), ("d",), ("z",)], "key string")
    got = changes.unknown_keys(rows, snapshot, key="key", order=["i"])
    assert got.columns == rows.columns
    assert sorted(((r.key, r.i) for r in got.collect()), key=str) == sorted([("b", 1), ("b", 3), (None, 1)], key=str)
    assert changes.unknown_keys(rows, snapshot.unionByName(spark.createDataFrame([(None,)], "key string")), key="key", order=["i"], hot_rows=2).count() == 2
