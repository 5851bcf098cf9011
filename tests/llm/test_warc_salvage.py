from test_warc import BIG, pages, records

from tallyloom.llm import registry, warc


def test_ids_of_nineteen_digits(spark, tmp_path):
    ids = [10**18, 2**63 - 1, -(2**63), 5]
    folder = f"file://{tmp_path}/w"
    warc.write_archives(warc.planned(pages(spark, [(i, "u", BIG, None) for i in ids])), folder)
    out = warc.resolved(warc.read_archives(warc.archive_files(spark, folder))).collect()
    assert sorted((r.page_id, r.refers_to) for r in out) == sorted((i, None if i == max(ids) else max(ids)) for i in ids)


def test_ids_beyond_a_long_are_none():
    assert warc._page("urn:page:9223372036854775808") is None and warc._page("urn:page:x") is None


def test_sound_records_of_failed_members():
    whole = records(40)
    packed, last = warc.member(b"".join(whole)), warc.member(records(60)[50])
    uris = lambda data: [x[2]["warc-target-uri"] for x in warc.salvage(data) if x[2]]
    gaps = lambda data: [x[:2] for x in warc.salvage(data) if x[2] is None]
    assert len(uris(packed)) == 40
    cut = packed[: len(packed) * 2 // 3]
    n = len(uris(cut))
    assert 10 < n < 40 and uris(cut) == [f"http://h/{i}" for i in range(n)] and gaps(cut) == [(0, len(cut))]
    broken = bytearray(packed)
    broken[len(packed) * 2 // 3 : len(packed) * 2 // 3 + 40] = b"\xff" * 40
    found = uris(bytes(broken) + last)
    assert 10 < len(found) < 41 and found[:10] == [f"http://h/{i}" for i in range(10)] and found[-1] == "http://h/50"
    assert gaps(bytes(broken) + last)[0][0] == 0


def test_the_query_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = registry.op3_warc(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_a_flipped_byte_near_the_end_leaves_the_records_before():
    packed = bytearray(warc.member(b"".join(records(20))))
    packed[-30] ^= 0x10
    got = list(warc.salvage(bytes(packed)))
    assert sum(x[2] is not None for x in got) >= 10 and sum(x[2] is None for x in got) == 1


def test_members_that_inflate_without_end(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 4 << 20)
    few = records(3)
    bomb = warc.member(b"".join(few) + b"\0" * (64 << 20))
    assert len(bomb) < 100_000
    got = list(warc.salvage(bomb + warc.member(few[0])))
    assert [x[2]["warc-target-uri"] for x in got if x[2]] == ["http://h/0", "http://h/1", "http://h/2", "http://h/0"]
    assert [x for x in got if x[2] is None][0][3].startswith("member inflates to more")


def test_a_sound_record_of_a_member_with_a_bad_trailer_is_given_and_marked():
    parts = [bytearray(warc.member(r)) for r in records(3)]
    parts[1][-6] ^= 1
    data = b"".join(map(bytes, parts))
    got = list(warc.salvage(data))
    assert [(x[2]["warc-record-id"], x[2].get("salvaged", "")[:5]) for x in got if x[2]] == [("<urn:page:0>", ""), ("<urn:page:1>", "gzip:"), ("<urn:page:2>", "")]
    assert [x[:2] for x in got if x[2] is None] == [(len(parts[0]), len(parts[0]) + len(parts[1]))]


def test_marks_reach_the_reader(spark):
    damaged = bytearray(warc.member(records(1)[0]))
    damaged[-6] ^= 1
    out = warc.read_archives(spark.createDataFrame([("f", damaged)], "path string, content binary")).collect()
    assert [(r.kind, (r.note or "")[:5]) for r in out] == [("record", "gzip:"), ("gap", "gzip:")]
