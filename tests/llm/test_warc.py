import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


BIG = "<p>" + "ä" * 600 + "</p>"


def rows():
    rng = random.Random(1)
    out = [(i, f"http://h/{i}", "".join(rng.choice("abc <>\n") for _ in range(rng.randrange(3000))), "x") for i in range(60)]
    return [*out, (70, "u", BIG, None), (71, "u", BIG, None), (75, None, BIG, None), (80, "u", "small", None), (81, "u", "small", None), (82, "u", None, None), (83, "u", "", None), (75, "again", BIG, None), (None, "nobody", BIG, None), (None, None, None, None), (84, "a\r\nInjected: yes", "z" * 200_000, None)]


def brute(given):
    payload = lambda h: (h or "").encode()
    top = {}
    for i, _, h, _ in given:
        if i is not None and len(payload(h)) >= 1000:
            top[payload(h)] = max(top.get(payload(h), i), i)
    out = []
    for i, _, h, _ in given:
        p = payload(h)
        first = top.get(p)
        again = i is not None and first is not None and i < first
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    given = rows()
    folder = f"file://{tmp_path}/w"
    files = warc.write_archives(warc.planned(pages(spark, given)), folder, roll_bytes=5_000)
    assert files.agg(F.sum("records")).first()[0] == len(given) and files.count() > 3
    records = warc.read_archives(warc.archive_files(spark, folder))
    assert records.where("kind = 'gap'").count() == 0
    out = warc.resolved(records, keep_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == brute(given)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in out)


def test_revisits_of_an_id_that_two_payloads_share(spark, tmp_path):
    from tallyloom.llm import registry

    other = BIG.replace("p>", "b>")
    given = [(5, "u", BIG, None), (5, "u", other, None), (2, "v", other, None), (3, "w", BIG, None), (5, "u", BIG, None)]
    pages(spark, given).write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.op3_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(given)


def test_a_revisit_without_a_digest_refers_by_id(spark):
    columns = "kind string, page_id long, record_type string, record_id string, refers_to string, payload_bytes long, digest string"
    rows = [("record", 1, "response", "a", None, 3, "ff"), ("record", 1, "response", "a", None, 4, "ee"), ("record", 2, "revisit", "b", "a", None, None), ("record", 3, "revisit", "c", "a", None, "ff"), ("record", 4, "revisit", "d", "a", None, "dd")]
    got = {r.page_id: tuple(r)[1:] for r in warc.resolved(spark.createDataFrame(rows, columns)).where("record_type = 'revisit'").collect()}
    assert got == {2: (4, "ee", "revisit", 1), 3: (3, "ff", "revisit", 1), 4: (None, "dd", "revisit", None)}


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    assert warc.write_archives(warc.planned(pages(spark, [])), folder).count() == 0


def records(n=12):
    return [warc.record_bytes(page_id=i, uri=f"http://h/{i}", payload=(b"%d " % i) * (50 + i), digest=hashlib.sha1((b"%d " % i) * (50 + i)).hexdigest(), refers_to=None) for i in range(n)]


def spans_cover(data, found):
    at = 0
    for start, stop, _, _ in found:
        if start != at and not (start, stop) == (at_span):
            return False
        at, at_span = stop, (start, stop)
    return at == len(data)


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_the_damaged_record_alone(packed):
    parts = [warc.member(r) if packed else r for r in records()]
    whole = b"".join(parts)
    cuts = [0]
    for p in parts:
        cuts.append(cuts[-1] + len(p))
    assert [x[2]["warc-record-id"] for x in warc.salvage(whole)] == [f"<urn:page:{i}>" for i in range(12)]
    rng = random.Random(7)
    for _ in range(60):
        hit = rng.randrange(12)
        head = 0 if packed else parts[hit].index(b"\r\n\r\n") + 4  # a plain record's header has no checksum
        at = rng.randrange(cuts[hit] + head, cuts[hit + 1])
        broken = bytearray(whole)
        broken[at] ^= 1 << rng.randrange(8)
        got = list(warc.salvage(bytes(broken)))
        names = [x[2]["warc-record-id"] for x in got if x[2] and "salvaged" not in x[2]]
        lost = [i for i in range(12) if f"<urn:page:{i}>" not in names]
        assert set(lost) <= {hit}
        gaps = [(a, z) for a, z, f, _ in got if f is None]
        assert len(gaps) == len(lost) and all((a, z) == (cuts[hit], cuts[hit + 1]) for a, z in gaps)
        assert spans_cover(bytes(broken), got)


def test_cuts_garbage_and_joined_members():
    parts = [warc.member(r) for r in records(4)]
    whole = b"".join(parts)
    got = list(warc.salvage(whole[:-5]))
    assert [x[2] is not None for x in got] == [True] * 4 + [False] and got[-1][3] == "member is cut short"
    assert ["salvaged" in x[2] for x in got[:4]] == [False, False, False, True]  # its trailer alone is cut
    assert [x[2] is not None for x in warc.salvage(whole[:-40])] == [True, True, True, False]
    got = list(warc.salvage(b"junk\x1f\x8b\x08junk" + whole))
    assert got[0][:2] == (0, 11) and got[0][2] is None and sum(x[2] is not None for x in got) == 4
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"only junk"))[0][:3] == (0, 9, None)
    two = warc.member(b"".join(records(2)))
    assert sum(x[2] is not None for x in warc.salvage(two)) == 2
    other = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert list(warc.salvage(other.compress(b"no record") + other.flush()))[0][2] is None


def test_gaps_are_logged_by_the_reader(spark):
    parts = [warc.member(r) for r in records(3)]
    data = parts[0] + b"\0" * 40 + parts[1][:30] + parts[2]
    out = warc.read_archives(spark.createDataFrame([("f", bytearray(data)), ("none", bytearray(b"")), ("null", None)], "path string, content binary")).collect()
    assert [(r.kind, r.start, r.stop) for r in out] == [("record", 0, len(parts[0])), ("gap", len(parts[0]), len(data) - len(parts[2])), ("record", len(data) - len(parts[2]), len(data))]
