"""Texts that are the same: Grace hash deduplication over spilled buckets and open-addressing tables that compare whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tallyloom.llm.bytescan import LOWER, release, text_bytes
from tallyloom.llm.columns import named
from tallyloom.llm.scratch import written

#: Bytes of rows that a task looks at together before anything is shuffled.
CHUNK_BYTES = 16 << 20
#: Bytes of different texts that one table holds; what does not fit goes to the next level.
TABLE_BYTES = 32 << 20
#: Rows of one hash, after the chunks, from which they meet by ``SALTS`` first (if they are 1 / ``FREQUENT`` of all rows too).
HOT_ROWS, FREQUENT, SALTS = 1000, 1000, 256
#: Row numbers that a task has.
TASK_ROWS = 1 << 33


class TextTable:
    """An open-addressing table of whole texts: linear probing, at most half full, entries numbered in order of arrival.

    A slot matches when the hash and then every byte of the text agree, so texts whose hashes collide stay apart.
    """

    def __init__(self, limit: int):
        self.limit, self.bytes = limit, 0
        self.slots, self.hashes, self.texts = [-1] * 64, [], []

    def place(self, hashed: int, text: bytes) -> int:
        """The entry of ``text``, a new one if there is none, or -1 if a new one would go beyond the limit. The first always fits."""
        slots, hashes, texts = self.slots, self.hashes, self.texts
        last = len(slots) - 1
        at = hashed & last
        while (entry := slots[at]) >= 0:
            if hashes[entry] == hashed and texts[entry] == text:
                return entry
            at = (at + 1) & last
        if texts and self.bytes + len(text) > self.limit:
            return -1
        slots[at] = len(texts)
        hashes.append(hashed)
        texts.append(text)
        self.bytes += len(text)
        if 2 * len(texts) > len(slots):
            self._grow()
        return len(texts) - 1

    def _grow(self) -> None:
        last = 4 * len(self.slots) - 1
        slots = [-1] * (last + 1)
        for entry, hashed in enumerate(self.hashes):
            at = hashed & last
            while slots[at] >= 0:
                at = (at + 1) & last
            slots[at] = entry
        self.slots = slots


def _keys(col: pa.Array) -> list[bytes]:
    """Each text in UTF-8 with A-Z lower-cased; null: empty."""
    raw, offsets = text_bytes(col)
    data = LOWER[raw].tobytes() if len(raw) else b""
    cut = offsets.tolist()
    return [data[lo:hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``CHUNK_BYTES`` together; a longer row is a chunk of its own."""
    held: list[pa.RecordBatch] = []
    size = 0

    def close() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        offsets = text_bytes(batch.column("text"))[1]
        lo = 0
        while lo < batch.num_rows:
            room = max(0, CHUNK_BYTES - size)
            hi = int(np.searchsorted(offsets, offsets[lo] + room, "right")) - 1
            hi = min(batch.num_rows, max(hi, lo if held else lo + 1))
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                size += int(offsets[hi] - offsets[lo])
                lo = hi
            if size >= CHUNK_BYTES or lo < batch.num_rows:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def _scan(rest: bool):
    """Numbers the rows, and for each chunk marks one row of each text: its largest id (null is least), then the last such row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * TASK_ROWS
        for chunk in _chunks(batches):
            table = TextTable(1 << 62)
            keys = _keys(chunk.column("text"))
            digests = [hashlib.sha256(k).digest() for k in keys]
            hashes = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
            entry = np.fromiter((table.place(h, k) for h, k in zip(hashes, keys, strict=True)), np.int64, len(keys))
            doc = chunk.column("doc")
            known = np.asarray(doc.is_valid())
            ids = doc.fill_null(0).to_numpy(zero_copy_only=False)
            order = np.lexsort((np.arange(len(ids)), ids, known, entry))
            ends = np.flatnonzero(np.append(np.diff(entry[order]), 1)) if len(order) else order
            best = order[ends]  # by entry, as entries are 0, 1, ...
            n = np.zeros(len(ids), np.int64)
            n[best] = np.bincount(entry)
            stands = pa.array(n > 0)
            absent = pa.nulls(len(ids), pa.string())
            columns = {
                "row": pa.array(number + np.arange(len(ids))),
                "token": pa.array(number + best[entry]),
                "doc": doc,
                "n": pa.array(n),
                "h": pa.array(hashes, pa.int64()),
                "size": pa.array([len(k) for k in keys], pa.int64()),
                "sha256": pa.array([d.hex() if m else None for d, m in zip(digests, n.tolist(), strict=True)], pa.string()),
                "text": pa.compute.if_else(stands, chunk.column("text").fill_null("").cast(pa.string()), absent),
                "absent": chunk.column("text").is_null(),
            }
            if rest:
                columns["rest"] = pa.compute.if_else(stands, chunk.column("rest"), pa.nulls(len(ids), chunk.column("rest").type))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            number += len(ids)
            release()

    return scan


def _fold(limit: int, stand_alone: bool):
    """A bucket, which is a shuffle partition, against its table: the class of each row that the table can tell.

    Other rows keep their text for the next level; where rows ``stand_alone`` they are classes of their own instead, and
    the first of each class keeps its text.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = TextTable(limit), []
        for batch in batches:
            tokens, hashes = batch.column("token").to_pylist(), batch.column("h").to_pylist()
            found: list[int | None] = []
            spills = np.zeros(len(tokens), bool)
            for i, (token, hashed, key) in enumerate(zip(tokens, hashes, _keys(batch.column("text")), strict=True)):
                entry = table.place(hashed, key)
                if entry == len(first):
                    first.append(token)
                found.append(first[entry] if entry >= 0 else token if stand_alone else None)
                spills[i] = found[-1] == token if stand_alone else entry < 0
            texts = pa.compute.if_else(pa.array(spills), batch.column("text"), pa.nulls(len(tokens), batch.column("text").type))
            columns = [texts if name == "text" else batch.column(name) for name in FOLDED]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.int64())], [*FOLDED, "class"])
        release()

    return fold


FOLDED = ["token", "doc", "n", "h", "size", "sha256", "text"]
_FOLDED_SCHEMA = "token long, doc long, n long, h long, size long, sha256 string, text string, class long"


def _spilled(docs: DataFrame, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """All rows, numbered, as a table; of equal texts of a chunk one has the text, the digest and how many they are."""
    columns = [named(id_col).cast("long").alias("doc"), named(text_col).cast("string").alias("text")]
    if rest:
        columns.append(F.struct(*[named(n).alias(f"c{k}") for k, n in enumerate(rest)]).alias("rest"))
    given = docs.select(*columns)
    schema = T._parse_datatype_string("row long, token long, doc long, n long, h long, size long, sha256 string, text string, absent boolean")
    if rest:
        schema = schema.add("rest", given.schema["rest"].dataType)
    return written(given.mapInArrow(_scan(bool(rest)), schema), "rows")


def _classed(rows: DataFrame) -> DataFrame:
    """``(token, doc, n, sha256, class)`` of the rows that stand for their chunk's copies: equal texts, and only these, share a class."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pending = rows.where("n > 0").select(*FOLDED)
    total = pending.count()
    per_hash = pending.groupBy("h").agg(F.count("*").alias("rows"))
    hot = per_hash.where((F.col("rows") >= HOT_ROWS) & (F.col("rows") > total / FREQUENT)).select("h")  # fewer than FREQUENT rows
    via = None
    if not hot.isEmpty():
        among = pending.join(F.broadcast(hot), "h").select(*FOLDED)
        met = among.repartition(max(tasks, SALTS), "h", F.pmod(F.xxhash64("token"), F.lit(SALTS)))
        via = written(met.mapInArrow(_fold(TABLE_BYTES, True), _FOLDED_SCHEMA), "salted").withColumnRenamed("class", "via")
        pending = pending.join(F.broadcast(hot), "h", "left_anti").select(*FOLDED).unionByName(via.where("token = via").select(*FOLDED))
    found, level = None, 0
    while True:
        size = pending.agg(F.sum("size")).first()[0]
        if size is None and level:
            break
        buckets = max(tasks, -(-2 * (size or 0) // TABLE_BYTES))
        folded = written(pending.repartition(buckets, F.xxhash64("h", F.lit(level))).mapInArrow(_fold(TABLE_BYTES, False), _FOLDED_SCHEMA), "bucket")
        done = folded.where("class is not null").drop("text", "h", "size")
        found = done if found is None else found.unionByName(done)
        pending, level = folded.where("class is null").select(*FOLDED), level + 1
    if via is None:
        return found
    ends = found.select(F.col("token").alias("via"), "class")
    stood = via.where("token = via").select("token")
    return found.join(stood, "token", "left_anti").unionByName(via.select("token", "doc", "n", "sha256", "via").join(ends, "via").drop("via"))


def _told(rows: DataFrame) -> DataFrame:
    """For each token: ``keep_id``, ``keep_row``, ``group_size`` and ``text_sha256`` of its class."""
    classed = _classed(rows)
    best = classed.groupBy("class").agg(F.max(F.struct("doc", "token")).alias("best"), F.sum("n").alias("group_size"), F.max("sha256").alias("text_sha256"))
    best = best.select("class", F.col("best.doc").alias("keep_id"), F.col("best.token").alias("keep_row"), "group_size", "text_sha256")
    return classed.select("token", "class").join(best, "class").drop("class")


def copy_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col`` (as long), ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of a group of equal texts the
    row with the largest id stays, a null id being the least; of rows that share that id too, exactly one stays.
    ``text_sha256`` is of the lower-cased text in UTF-8. Other columns, of any names, are not looked at. Empty input:
    empty output.

    Plan: each task first folds the copies of a chunk of rows, so a text sends at most one row a chunk, however common it
    is, and the rows are written once, numbered. What stands for a chunk goes to buckets by its hash; a bucket is one
    shuffle partition, met by a table of at most ``TABLE_BYTES`` of different texts that compares whole texts. Copies of
    what is in the table add nothing to it; texts that do not fit are written and dealt to new buckets by other bits, and
    so on until none is left: every level takes at least one text a bucket, and buckets are as many as the bytes ask for.
    Hashes with very many rows even so meet in ``SALTS`` parts first. Memory is a chunk or a table, whatever the input.
    """
    rows = _spilled(docs, id_col, text_col, [])
    out = rows.select("row", "token", "doc").join(_told(rows), "token")
    return out.select(F.col("doc").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay (see ``copy_groups``), with all their columns, texts unchanged."""
    others = [n for n in docs.columns if n != text_col]
    rows = _spilled(docs, id_col, text_col, others)
    stay = _told(rows).where("token = keep_row").select("token")
    out = rows.where("n > 0").join(stay, "token")
    back = {n: F.col("rest").getField(f"c{k}") for k, n in enumerate(others)} | {text_col: F.when(~F.col("absent"), F.col("text"))}
    return out.select(*[back[n].alias(n) for n in docs.columns])
