"""Documents packed into sequences of a fixed number of tokens: large items matched in pairs, small ones best-fitted."""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.llm.columns import named, renamed
from tallyloom.llm.scratch import written


#: Runs of white space from which on a text is left to the ``tokenizers`` library, as the faster one's pattern search runs out of stack.
_LONG_RUN = 100_000
_RUNS = re.compile(r"\s{%d}" % _LONG_RUN)


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _encoder(vocabulary: str, pattern: str):
    """From a text to its ids under the vocabulary file's text; made once a worker process."""
    import tiktoken
    from tokenizers import Tokenizer

    cache = sys.modules.setdefault("_tallyloom_encoders", types.ModuleType("_tallyloom_encoders")).__dict__
    key = f"{zlib.crc32(vocabulary.encode())}-{len(vocabulary)}"
    if key not in cache:
        spec, letters = json.loads(vocabulary), _byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> list[int]:
            if len(text) >= _LONG_RUN and _RUNS.search(text):
                if f"{key}-slow" not in cache:
                    cache[f"{key}-slow"] = Tokenizer.from_str(vocabulary)
                return cache[f"{key}-slow"].encode(text, add_special_tokens=False).ids
            return fast.encode(text, allowed_special="all")

        cache[key] = encode
    return cache[key]


def _fits_two_bytes(vocabulary: str) -> bool:
    spec = json.loads(vocabulary)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) < 1 << 16


def wide(col: pa.Array, lengths: np.ndarray) -> pa.Array:
    """Binary ids of two bytes each as four bytes each; those that have four already (by ``lengths``) as they are."""
    values = col.to_pylist()
    return pa.array([x if len(x) == 4 * n else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, n in zip(values, lengths.tolist(), strict=True)], pa.binary())


def tokenised(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, end_id: int = 2, capacity: int = 1024, keep_ids: bool = True, narrow: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, with ``keep_ids`` also ``ids``.

    A document is its byte-pair ids under the vocabulary file (a tokenizers JSON file of byte-level kind), then
    ``end_id``. Strings of special tokens in a text count as these tokens. Only longer documents are cut, into full
    pieces after a first one that may be shorter. Null text: empty. ``ids_crc32`` is of little-endian unsigned 32-bit
    ids. The encoder is the BPE library with the faster core of the two, but for texts with very long runs of white space,
    which the other one takes; the vocabulary and so the ids are the same. Empty input: empty output. ``ids`` hold four
    bytes an id, or with ``narrow`` two if the vocabulary allows it (``wide`` undoes that).
    """
    import public_tokenizers

    with open(vocabulary_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    narrow = narrow and _fits_two_bytes(text)
    vocabulary = docs.sparkSession.sparkContext.broadcast(text)  # of a fixed size, whatever the corpus
    pattern = public_tokenizers.PATTERN

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary.value, pattern)
        unit, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[tuple] = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    cut, piece = 0, 0
                    while cut < len(ids):
                        size = (len(ids) - cut) % capacity or capacity
                        data = ids[cut : cut + size].tobytes()
                        rows.append((i, piece, cut, size, zlib.crc32(data), int(seen[size]), ids[cut : cut + size].astype("<u2").tobytes() if narrow else data))
                        seen[size] += 1
                        cut, piece = cut + size, piece + 1
                at, piece, start, size, crc, rank, data = zip(*rows, strict=True) if rows else [()] * 7
                out = [part.column("id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array([unit] * len(at), pa.int64()), pa.array(rank, pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(data, pa.binary())] if keep_ids else [])], ["id", "piece", "start", "length", "ids_crc32", "unit", "rank", *["ids"] * keep_ids])

    given = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return given.mapInArrow(scan, f"id {kind}, piece int, start long, length long, ids_crc32 long, unit long, rank long" + ", ids binary" * keep_ids)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where items go, by size alone: rows (size, first rank, end rank, first bin, items a bin, offset).

    The r-th item of a size, first <= r < end, goes to bin ``first bin + (r - first) // items a bin`` at ``offset +
    size * ((r - first) % items a bin)``. Work and result depend on the number of distinct sizes, not on that of items.

    Items above a third of the capacity: from the largest down, each with the largest one that still fits beside it, two
    a bin at most. The others, from the largest down, go where the gap is the smallest that holds them, else to new bins.
    """
    left = dict(counts)
    taken = dict.fromkeys(counts, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of bins (first bin, number)
    bins = 0

    def put(size: int, n: int, first_bin: int, each: int, offset: int) -> None:
        rows.append((size, taken[size], taken[size] + n, first_bin, each, offset))
        taken[size] += n
        left[size] -= n

    large = sorted((s for s in counts if 3 * s > capacity), reverse=True)
    for a in large:
        while left[a] > 0:
            b = next((s for s in large if s <= min(a, capacity - a) and left[s] >= 1 + (s == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, n, bins, 1, 0)
            if b is not None:
                put(b, n, bins, 1, a)
            gaps.setdefault(capacity - a - (b or 0), []).append((bins, n))
            bins += n
    for s in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        for gap in range(s, capacity + 1):
            runs, gaps[gap] = gaps.get(gap, []), []
            while runs and left[s] > 0:
                first, n = runs.pop()
                each = gap // s
                full = min(n, left[s] // each)
                if full:
                    put(s, full * each, first, each, capacity - gap)
                    gaps.setdefault(gap - each * s, []).append((first, full))
                    first, n = first + full, n - full
                if n and left[s] > 0:  # fewer than fill one bin
                    rest = left[s]
                    put(s, rest, first, rest, capacity - gap)
                    gaps.setdefault(gap - rest * s, []).append((first, 1))
                    first, n = first + 1, n - 1
                if n:
                    runs.append((first, n))
            gaps[gap] = gaps[gap] + runs
            if not left[s]:
                break
        if left[s] > 0:
            each = capacity // s
            full, rest = divmod(left[s], each)
            if full:
                put(s, full * each, bins, each, 0)
                gaps.setdefault(capacity - each * s, []).append((bins, full))
                bins += full
            if rest:
                put(s, rest, bins, rest, 0)
                gaps.setdefault(capacity - rest * s, []).append((bins, 1))
                bins += 1
    return rows


def packed(pieces: DataFrame, *, id_col: str = "doc_id", capacity: int = 1024) -> DataFrame:
    """``pieces`` (a table written from ``tokenised``) with ``sequence_id`` and ``offset``.

    Only the number of pieces of each length, at most ``capacity`` numbers, goes to the driver; the plan made from it is
    broadcast. The rank of a piece among those of its length is its rank in the task that made it plus the sums of the
    tasks before, so no length, however frequent, is sorted or gathered. Empty input: empty output.
    """
    units = pieces.groupBy("length", "unit").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan_bins(counts, capacity)
    by_size: dict[int, np.ndarray] = {s: np.array([r for r in rows if r[0] == s], np.int64) for s in counts}
    held = pieces.sparkSession.sparkContext.broadcast(by_size)
    before = units.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("length", "unit", F.coalesce("before", F.lit(0)).alias("before")), ["length", "unit"])
    names = [n for n in pieces.columns if n not in ("unit", "rank")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size).tolist():
                at, plan = np.flatnonzero(size == s), held.value[s]
                k = np.searchsorted(plan[:, 1], rank[at], "right") - 1
                step = rank[at] - plan[k, 1]
                sequence[at] = plan[k, 3] + step // plan[k, 4]
                offset[at] = plan[k, 5] + s * (step % plan[k, 4])
            yield pa.RecordBatch.from_arrays([*(wide(batch.column(n), size) if n == "ids" else batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], ["doc" if n == "id" else n for n in names] + ["sequence_id", "offset"])

    types_ = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    out = ranked.select(*names, "rank", "before").mapInArrow(place, ", ".join([f"{'doc' if n == 'id' else n} {types_[n]}" for n in names] + ["sequence_id long", "offset long"]))
    return renamed(out, "doc", id_col)


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, end_id: int = 2, capacity: int = 1024, keep_ids: bool = True) -> DataFrame:
    """``docs`` tokenised, cut and packed: a row a piece with its sequence and its offset there, offsets gapless from 0.

    Rows without an id are packed like others. Rows that share an id are packed each (their pieces are told apart by
    sequence and offset). Other columns are not returned. Between the two steps ids take two bytes each if they can.
    """
    pieces = written(tokenised(docs, id_col=id_col, text_col=text_col, vocabulary_path=vocabulary_path, end_id=end_id, capacity=capacity, keep_ids=keep_ids, narrow=True), "pieces")
    return packed(pieces, id_col=id_col, capacity=capacity)
