"""Passages that repeat across documents, found by difference-cover anchors and then extended to whole windows.

A difference cover D modulo v holds, for any two offsets i and j, some k < v with both i + k and j + k in D (mod v).
Two equal windows of W words at word positions i and j therefore share an anchor of A <= W - v + 1 words that starts at
i + k and j + k, both cover positions. So only |D| / v of all positions are hashed in the first pass, and no match of
W words is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tallyloom.llm.bytescan import row_of, run_sum, signed, slices, span_hashes, spans, text_bytes, window_hashes
from tallyloom.llm.columns import named
from tallyloom.llm.scratch import written

#: A perfect difference set: every non-zero residue modulo 31 is the difference of one pair.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)

_HITS = "__hits"


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length in words for matches of ``window`` words."""
    for period, cover in ((PERIOD, COVER), (13, (0, 1, 3, 9)), (7, (0, 1, 3)), (3, (0, 1)), (1, (0,))):
        anchor = window - period + 1
        if anchor >= max(1, window // 3):
            return period, cover, anchor
    raise ValueError("window must be 1 or more")


def _scan(col: pa.Array) -> tuple[np.ndarray, ...]:
    raw, offsets = text_bytes(col)
    starts, ends, first = spans(raw, offsets)
    return raw, starts, ends, first, span_hashes(raw, starts, ends)


def _inside(first: np.ndarray, row: np.ndarray, length: int) -> np.ndarray:
    """For each word position: does a run of ``length`` words from there end in the same row?"""
    n = max(0, len(row) - length + 1)
    return np.arange(n) + length <= first[row[:n] + 1]


#: Hashes that a task looks at together before it sends them on.
LOCAL = 2_000_000

_SENT = "key long, known boolean, doc long, hash long"


def _settled(parts: Iterator[tuple[np.ndarray, np.ndarray]], both: bool) -> Iterator[pa.RecordBatch]:
    """Of (documents, hashes), what a task can settle and what it has to send.

    For each hash one row is sent by hash, with the least document; however often a hash occurs, a task sends one. The
    other documents of the hash are ``known`` already; with ``both`` so is the least, if there is another. Known rows
    are dealt by document.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def close() -> pa.RecordBatch:
        doc, value = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((doc, value))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), bool)
        new[1:] = value[1:] != value[:-1]
        fresh = new.copy()
        fresh[1:] |= doc[1:] != doc[:-1]
        doc, value, new = doc[fresh], value[fresh], new[fresh]
        known = ~new
        if both:
            known[:-1] |= ~new[1:]
        doc, value = np.concatenate([doc[new], doc[known]]), np.concatenate([value[new], value[known]])
        is_known = np.arange(len(doc)) >= int(new.sum())
        key = np.where(is_known, doc, value)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(is_known), pa.array(doc), pa.array(np.where(is_known, value, 0))], ["key", "known", "doc", "hash"])

    for doc, value in parts:
        held.append((doc, value))
        if sum(len(d) for d, _ in held) > LOCAL:
            yield close()
    if held:
        yield close()


def _anchors(window: int):
    """From texts to the distinct anchors at cover positions of every document with ``window`` words or more."""
    period, cover, length = cover_for(window)
    on = np.zeros(period, bool)
    on[list(cover)] = True

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for part in slices(batch, "body"):
                _, _, _, first, words = _scan(part.column("body"))
                hashed, row = window_hashes(words, length), row_of(first)
                ok = _inside(first, row, length)
                n = len(ok)
                ok &= on[(np.arange(n) - first[row[:n]]) % period] & (np.diff(first)[row[:n]] >= window)
                yield part.column("doc").to_numpy()[row[:n][ok]], signed(hashed[ok])

    return lambda batches: _settled(parts(batches), True)


def _extended(window: int):
    """From texts and their shared anchors to the hashes of all whole windows that hold such an anchor."""
    _, _, length = cover_for(window)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for part in slices(batch, "body"):
                _, _, _, first, words = _scan(part.column("body"))
                anchor, whole, hits = signed(window_hashes(words, length)), signed(window_hashes(words, window)), part.column(_HITS)
                picked, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in range(part.num_rows):
                    lo, n = first[i], first[i + 1] - first[i]
                    if n < window:
                        continue
                    found = np.isin(anchor[lo : lo + n - length + 1], hits[i].values.to_numpy(zero_copy_only=False))
                    seen = np.zeros(len(found) + 1, np.int64)
                    np.cumsum(found, out=seen[1:])
                    k = n - window + 1  # window starts; each holds the anchors that start at most window - length later
                    at = np.flatnonzero(seen[window - length + 1 : window - length + 1 + k] > seen[:k])
                    picked.append(whole[lo + at])
                    rows.append(np.full(len(at), i))
                yield part.column("doc").to_numpy()[np.concatenate(rows)], np.concatenate(picked)

    return lambda batches: _settled(parts(batches), False)


def drop_repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``docs`` with every word removed that lies in a window of ``window`` words which also starts in a smaller id.

    Words are runs without ASCII white space, unchanged. Windows are judged on the input. Kept words are joined by one
    space. Adds ``n_words`` and ``n_removed`` (columns of these names are replaced); ``n_chars``, if there, follows.

    Null text: no words, empty text. Rows without an id keep all words and count for nothing; rows that share an id
    count as one document. Texts shorter than a window keep all words. Empty input: empty output. Other columns, of any
    names, pass through.

    Plan: anchors are a fifth of the word positions. A task sends each distinct hash once, with the least id that has
    it there, and settles all else itself; so a passage in every document costs a row a task, and no hash gathers more
    rows than there are tasks. Only windows around shared anchors are hashed whole, and settled alike. Equal texts are
    looked at once: all windows of a later copy start in the first one too. Joins with texts share one shuffle of them.
    """
    names = [n for n in docs.columns if n not in ("n_words", "n_removed")]
    others = [n for n in names if n not in (id_col, text_col)]
    kept = T.StructType([T.StructField("doc", T.LongType()), T.StructField("body", T.StringType())])
    schema = T.StructType([*kept.fields, *([T.StructField("rest", T.StructType([docs.schema[n] for n in others]))] if others else [])]).add("n_words", "long").add("n_removed", "long")
    given = docs.select(named(id_col).cast("long").alias("doc"), named(text_col).cast("string").alias("body"))
    base = docs.select(named(id_col).cast("long").alias("doc"), named(text_col).cast("string").alias("body"), *([F.struct(*[named(n).alias(n) for n in others]).alias("rest")] if others else []))

    texts = given.where("doc is not null and body is not null").select("doc", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2"))
    firsts = texts.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    copies = written(texts.join(firsts, ["h1", "h2"]).where("doc > least").groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("h1").alias("__copies")), "copies")
    copied = F.coalesce(F.array_contains("__copies", F.xxhash64("body")), F.lit(False))
    marked = given.join(copies, F.col("doc") == F.col("__doc"), "left").where(~copied & F.col("doc").isNotNull()).select("doc", "body")

    each = Window.partitionBy("key", "known")
    value = F.when(F.col("known"), F.col("hash")).otherwise(F.col("key"))
    found = marked.mapInArrow(_anchors(window), _SENT).withColumn("n", F.count("*").over(each))
    hits = found.where("known or n > 1").groupBy(F.col("doc").alias("__doc")).agg(F.collect_set(value).alias(_HITS))
    around = given.join(hits, F.col("doc") == F.col("__doc")).select("doc", "body", _HITS)
    whole = around.mapInArrow(_extended(window), _SENT).withColumn("least", F.min("doc").over(each))
    repeats = whole.where("known or doc > least").groupBy(F.col("doc").alias("__doc")).agg(F.collect_set(value).alias(_HITS))
    gone_from = repeats.select("__doc", _HITS, F.lit(None).cast("array<long>").alias("__copies")).unionByName(copies.select("__doc", F.lit(None).cast("array<long>").alias(_HITS), "__copies"))
    gone_from = gone_from.groupBy("__doc").agg(F.first(_HITS, ignorenulls=True).alias(_HITS), F.first("__copies", ignorenulls=True).alias("__copies"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                raw, starts, ends, first, words = _scan(part.column("body"))
                whole, hits, copied = signed(window_hashes(words, window)), part.column(_HITS), np.asarray(part.column("__copied"))
                gone = np.zeros(len(words), bool)
                for i in np.flatnonzero(np.asarray(hits.is_valid()) | copied):
                    lo, n = first[i], first[i + 1] - first[i]
                    if n < window:
                        continue
                    if copied[i]:
                        gone[lo : lo + n] = True
                        continue
                    at = np.flatnonzero(np.isin(whole[lo : lo + n - window + 1], hits[int(i)].values.to_numpy(zero_copy_only=False)))
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                    gone[lo : lo + n] = np.cumsum(step[:n]) > 0
                out = [part.column("doc"), _joined(raw, starts, ends, first, gone), *([part.column("rest")] if others else [])]
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.diff(first)), pa.array(run_sum(gone, first))], schema.names)

    # rows without an id stay outside the join, so that it reads the same shuffle of texts as the join before
    joined = base.where("doc is not null").join(gone_from, F.col("doc") == F.col("__doc"), "left").withColumn("__copied", copied).drop("__doc", "__copies")
    joined = joined.unionByName(base.where("doc is null").withColumns({_HITS: F.lit(None).cast("array<long>"), "__copied": F.lit(False)}))
    done = joined.mapInArrow(rebuild, schema)
    back = {id_col: F.col("doc").cast(docs.schema[id_col].dataType), text_col: F.col("body")} | {n: F.col("rest").getField(n) for n in others}
    if "n_chars" in others:
        back["n_chars"] = F.char_length("body").cast(docs.schema["n_chars"].dataType)
    return done.select(*(back[n].alias(n) for n in names), "n_words", "n_removed")


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, gone: np.ndarray) -> pa.Array:
    """The words that are not ``gone``, joined by one space, a text for each row."""
    keep = ~gone
    starts, ends = starts[keep], ends[keep]
    counts = run_sum(keep, first)
    lengths = ends - starts + 1  # with the space after it
    place = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=place[1:])
    out = np.full(int(place[-1]), 0x20, np.uint8)
    # copy all words at once: for each byte of the output but the spaces, where it comes from
    shift = np.repeat(starts - place[:-1], lengths - 1)
    to = np.arange(int(place[-1]))
    mask = np.ones(len(to), bool)
    mask[place[1:] - 1] = False
    to = to[mask]
    out[to] = raw[to + shift]
    last = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=last[1:])
    lo, hi, data = place[last[:-1]], place[last[1:]], out.tobytes()
    return pa.array([data[a : b - 1] if b > a else b"" for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()).cast(pa.string())
