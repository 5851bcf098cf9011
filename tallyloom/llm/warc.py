"""WARC archives: written in members of one record, and read back by a reader that salvages what damage leaves."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm.columns import named
from tallyloom.llm.scratch import written

#: Bytes of an archive file after which the writer starts the next one; also bounds what a reading task holds.
ROLL_BYTES = 16 << 20
#: Bytes given to the decompressor at once, and taken from it.
STEP, GIVEN = 16 << 10, 1 << 20
#: Bytes that one member may inflate to; what it holds beyond them is quarantined, so that a small file cannot fill an executor.
MEMBER_BYTES = 256 << 20
VERSION = b"WARC/1.1"
_GZIP = b"\x1f\x8b\x08"
_NAMES = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)\r?\n")

RECORD = "path string, start long, stop long, kind string, note string, record_type string, record_id string, refers_to string, uri string, digest string, page_id long, payload_bytes long, payload binary"


def _id(page_id: int | None, uri: str) -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:uri:{hashlib.sha1(uri.encode()).hexdigest()}"


def _b32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record_bytes(*, page_id: int | None, uri: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with an HTTP head and the payload, or a revisit with the head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{_id(page_id, uri)}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", uri),
        "WARC-Payload-Digest": _b32(digest),
        "WARC-Block-Digest": _b32(hashlib.sha1(block).hexdigest()),
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        fields["WARC-Refers-To"] = f"<{_id(refers_to, '')}>"
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    fields["Content-Length"] = str(len(block))
    lines = b"".join(k.encode() + b": " + v.encode() + b"\r\n" for k, v in fields.items())
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member that holds ``record``; equal records make equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _parse(data: bytes, at: int) -> tuple[int, dict[str, str], bytes] | str:
    """The record at ``at``: where it ends, its fields and its block, or what is wrong with it."""
    line = re.compile(rb"WARC/\d\.\d\r?\n").match(data, at)
    if not line:
        return "no version line"
    fields, pos = {}, line.end()
    while m := _NAMES.match(data, pos):
        fields[m[1].decode().lower()], pos = m[2].decode("utf-8", "replace").strip(), m.end()
    end = re.compile(rb"\r?\n").match(data, pos)
    if not end:
        return "broken header"
    if not fields.get("content-length", "").isdigit():
        return "no content length"
    start = end.end()
    stop = start + int(fields["content-length"])
    if stop > len(data):
        return "block is cut short"
    block = data[start:stop]
    stated = fields.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        return "block digest differs"
    tail = re.compile(rb"\r?\n\r?\n").match(data, stop)
    if not tail:
        return "no end of record"
    return tail.end(), fields, block


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
    """Records and gaps of an archive in order: (start, stop, fields, block), or (start, stop, None, reason) for a gap.

    At each place a gzip member or a plain record is tried. When a check fails, the next places that look like the start
    of a member or of a version line are tried one by one until one holds a valid record; all before it is one gap. A
    member with more than one record yields all that are sound. A member that is cut short yields the records before the
    cut, one that is damaged (be it in its trailer alone) those whose block digest verifies; they have a field ``salvaged``
    that says what is wrong with the member, which counts as a gap too. So does a member that inflates to more than
    ``MEMBER_BYTES``, after the records within these. Every byte is in exactly one record's or gap's span but for members
    of many records, whose records share the member's span, and for records of failed members. Work is linear in the
    number of starts tried. No bytes: nothing.
    """
    at, bad_from, reason = 0, None, ""
    starts = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")
    while at < len(data):
        found: list[tuple[int, int, dict[str, str] | None, bytes | str]] = []
        part: list[tuple[int, int, dict[str, str] | None, bytes | str]] = []
        wrong = "neither a member nor a record"
        stop = at
        if data.startswith(_GZIP, at):
            text, end, why = _inflated(data, at)
            inner = list(salvage_plain(text))
            if end is not None:
                stop = end
                if any(x[2] is not None for x in inner):
                    found = [(at, stop, fields, block) for _, _, fields, block in inner]
                else:
                    wrong = inner[0][3] if inner else "empty member"
            else:
                wrong = why
                # what came out before damage may be wrong unless a digest says otherwise; what came out before a cut is not
                part = [x for x in inner if x[2] is not None and (not why.startswith("gzip") or x[2].get("warc-block-digest", "").startswith("sha1:"))]
        elif data.startswith(b"WARC/", at):
            got = _parse(data, at)
            if isinstance(got, str):
                wrong = got
            else:
                stop = got[0]
                found = [(at, stop, got[1], got[2])]
        if found:
            if bad_from is not None:
                yield bad_from, at, None, reason
                bad_from = None
            yield from found
            at = stop
            continue
        if bad_from is None:
            bad_from, reason = at, str(wrong)
        after = starts.search(data, at + 1)
        next_at = after.start() if after else len(data)
        yield from ((at, next_at, fields | {"salvaged": str(wrong)}, block) for _, _, fields, block in part)
        at = next_at
    if bad_from is not None:
        yield bad_from, len(data), None, reason


def _inflated(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What the member at ``at`` holds, where it ends, and if it does not end soundly (no end), why.

    Of a damaged member this is all before the byte that fails, of one that is cut short or inflates to more than
    ``MEMBER_BYTES`` all that is there or within these.
    """
    unpacker, got_to, parts, size = zlib.decompressobj(31), at, [], 0
    fed = b""
    while not unpacker.eof:
        if not fed:
            if got_to >= len(data):
                return b"".join(parts), None, "member is cut short"
            fed, got_to = data[got_to : got_to + STEP], min(len(data), got_to + STEP)
        before = unpacker.copy()
        try:
            parts.append(unpacker.decompress(fed, GIVEN))
        except zlib.error as e:
            try:  # the step once more, byte by byte
                for k in range(len(fed)):
                    parts.append(before.decompress(fed[k : k + 1]))
            except zlib.error:
                pass
            return b"".join(parts), None, f"gzip: {str(e)[:60]}"
        fed = unpacker.unconsumed_tail
        size += len(parts[-1])
        if size > MEMBER_BYTES:
            return b"".join(parts), None, f"member inflates to more than {MEMBER_BYTES} bytes"
    return b"".join(parts), got_to - len(unpacker.unused_data), ""


def _page(ident: str) -> int | None:
    """The page id in a record id, if it is a long."""
    found = re.fullmatch(r"-?[0-9]{1,19}", ident.removeprefix("urn:page:"))
    return int(found[0]) if found and -(1 << 63) <= int(found[0]) < 1 << 63 else None


def salvage_plain(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
    """``salvage`` of uncompressed records."""
    at, bad_from, reason = 0, None, ""
    starts = re.compile(rb"WARC/\d\.\d\r?\n")
    while at < len(data):
        got = _parse(data, at)
        if not isinstance(got, str):
            if bad_from is not None:
                yield bad_from, at, None, reason
                bad_from = None
            yield at, got[0], got[1], got[2]
            at = got[0]
            continue
        if bad_from is None:
            bad_from, reason = at, got
        after = starts.search(data, at + 1)
        at = after.start() if after else len(data)
    if bad_from is not None:
        yield bad_from, len(data), None, reason


def planned(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """``(page_id, uri, payload, digest, refers_to)``: of equal payloads of ``least_bytes`` or more, those below the largest id revisit it.

    Null payload: empty. Null url: empty. A row without an id is always a response. Of rows that share the largest id
    and the payload all are responses. Payloads are grouped by SHA-1 with a map-side combine; only keys are shuffled for
    that. Payloads are shuffled once, by page.
    """
    rows = pages.select(named(id_col).cast("long").alias("page_id"), F.coalesce(named(url_col).cast("string"), F.lit("")).alias("uri"), F.encode(F.coalesce(named(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    keys = rows.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    large = keys.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = keys.join(large, "digest").where("page_id < first").select("page_id", "digest", "first").distinct()
    revisits = revisits.groupBy(F.col("page_id").alias("__page")).agg(F.map_from_entries(F.collect_list(F.struct("digest", "first"))).alias("firsts"))
    # one shuffle of payloads, by page, which is also how archives are dealt
    place = F.coalesce("page_id", F.xxhash64("uri", "digest"))
    dealt = rows.withColumn("place", place).repartition("place")
    joined = dealt.join(revisits, F.col("place") == F.col("__page"), "left")
    first = F.when(F.col("page_id").isNotNull(), F.try_element_at("firsts", F.col("digest")))
    return joined.select("page_id", "uri", "payload", "digest", first.alias("refers_to"))


def write_archives(plan: DataFrame, folder: str, *, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes ``planned`` rows as ``.warc.gz`` files into ``folder``; returns (path, records, bytes) of each, evaluated once.

    ``folder`` is a URI that all executors share. A task sorts its rows, so a task that runs again, wherever, writes the
    same bytes under the same names; each file appears whole, by a rename. A file ends after ``roll_bytes``. The folder is
    made first, so a plan without rows leaves an empty one.
    """
    spark = plan.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        unit, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        held: list[bytes] = []
        out: list[tuple[str, int, int]] = []
        size = 0

        def close() -> None:
            name = f"{root}/part-{unit:06d}-{len(out):05d}.warc.gz"
            with store.open_output_stream(f"{name}.{attempt}.tmp") as f:
                for x in held:
                    f.write(x)
            store.move(f"{name}.{attempt}.tmp", name)
            out.append((name, len(held), sum(map(len, held))))
            held.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                page, uri, payload, digest, refers = (batch.column(c)[row].as_py() for c in ("page_id", "uri", "payload", "digest", "refers_to"))
                held.append(member(record_bytes(page_id=page, uri=uri, payload=payload, digest=digest, refers_to=refers)))
                size += len(held[-1])
                if size >= roll_bytes:
                    close()
                    size = 0
        if held:
            close()
        names, counts, sizes = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    dealt = plan.sortWithinPartitions("page_id", "digest", "uri")
    return written(dealt.mapInArrow(write, "path string, records long, bytes long"), "archives")


def read_archives(files: DataFrame, *, keep_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of archives given as ``(path, content)`` rows, as Spark's binaryFile source gives them.

    ``kind`` is ``record`` or ``gap``; a gap has its byte span and, as ``note``, the check that failed first; a record has a
    note if it was salvaged from a member that failed. Response
    payloads are held against their payload digest; one that differs is a gap. Rows of empty files are none.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for start, stop, fields, block in salvage(content.as_py() or b""):
                    row = dict.fromkeys(names) | {"path": path, "start": start, "stop": stop}
                    if fields is None:
                        row |= {"kind": "gap", "note": block}
                    else:
                        kind, ident = fields.get("warc-type"), fields.get("warc-record-id", "").strip("<>")
                        head, _, payload = block.partition(b"\r\n\r\n") if kind in ("response", "revisit") else (b"", b"", block)
                        stated = fields.get("warc-payload-digest", "")
                        row |= {"kind": "record", "note": fields.get("salvaged"), "record_type": kind, "record_id": ident, "refers_to": fields.get("warc-refers-to", "").strip("<>") or None, "uri": fields.get("warc-target-uri"), "digest": base64.b32decode(stated[5:]).hex() if re.fullmatch(r"sha1:[A-Z2-7]{32}", stated) else None, "page_id": _page(ident)}
                        if kind != "revisit":
                            row |= {"payload": payload if keep_payload else None, "payload_bytes": len(payload)}
                            if row["digest"] not in (None, hashlib.sha1(payload).hexdigest()):
                                row = dict.fromkeys(names) | {"path": path, "start": start, "stop": stop, "kind": "gap", "note": "payload digest differs"}
                            size += len(payload)
                    rows.append(row)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(scan, RECORD)


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder as ``(path, content)`` rows; none if it holds none."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")


def resolved(records: DataFrame, *, keep_payload: bool = False) -> DataFrame:
    """Records by page: a revisit gets the size and digest (with ``keep_payload`` the payload) of the response it refers to.

    A revisit refers to the response with its record id and its payload digest, so responses that share an id stay apart;
    a revisit that states no digest refers to the response of the least digest. A revisit whose response is not among
    ``records`` keeps its own digest and has a null size and ``refers_to``. Gaps give no row; a record without a page id
    has a null one. Empty input: empty output.
    """
    own = ["page_id", "record_type", "record_id", "refers_to", "payload_bytes", "digest", *["payload"] * keep_payload]
    found = records.where("kind = 'record'").select(*own)
    stated = F.coalesce("digest", F.lit(""))
    asked = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id"), stated.alias("__asked")).distinct()
    same = (F.col("__asked") == stated) | (F.col("__asked") == "")
    first = found.where("record_type = 'response'").join(asked, "record_id").where(same)
    columns = {"__page": "page_id", "__bytes": "payload_bytes", "__digest": "digest"} | ({"__payload": "payload"} if keep_payload else {})
    first = first.groupBy(F.col("record_id").alias("__id"), "__asked").agg(F.min_by(F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), stated).alias("__first"))
    first = first.select("__id", "__asked", "__first.*")
    joined = found.join(first, (F.col("refers_to") == F.col("__id")) & (stated == F.col("__asked")), "left")
    return joined.select(
        "page_id",
        F.coalesce("payload_bytes", "__bytes").alias("payload_bytes"),
        F.coalesce("__digest", "digest").alias("payload_digest"),
        "record_type",
        F.col("__page").alias("refers_to"),
        *([F.coalesce("payload", "__payload").alias("payload")] if keep_payload else []),
    )
