"""Lines that many documents share: explode, hash, count documents by hash, drop, reassemble by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyloom.llm.bytescan import LOWER, SOLID, run_sum, signed, slices, span_hashes, text_bytes
from tallyloom.llm.columns import named
from tallyloom.llm.scratch import written

#: White space that is stripped from lines by steps of one byte; longer runs are looked up.
STEPS = 16
#: Keys with more than this part of all lines do not meet in one task when lines look up what is shared.
FREQUENT = 1000


def _lines(col: pa.Array) -> tuple[np.ndarray, ...]:
    """Line starts and ends, the row's first line, and two hashes and the code points of each line's key."""
    raw, offsets = text_bytes(col)
    breaks = np.flatnonzero(raw == 10)
    rows = len(offsets) - 1
    count = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(count, out=first[1:])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    head = np.zeros(first[-1], bool)
    head[first[:-1]] = True
    tail = np.zeros(first[-1], bool)
    tail[first[1:] - 1] = True
    starts[head], starts[~head] = offsets[:-1], breaks + 1
    ends[tail], ends[~tail] = offsets[1:], breaks
    key_lo, key_hi = _stripped(raw, starts, ends)
    low = LOWER[raw] if len(raw) else raw
    return starts, ends, first, span_hashes(low, key_lo, key_hi, 1), span_hashes(low, key_lo, key_hi, 2), _points(raw, key_lo, key_hi)


def _stripped(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the white space at both ends; linear in the text, however long a run of white space is."""
    lo, hi = starts.copy(), ends.copy()
    alive = np.flatnonzero(lo < hi)  # by steps, each over the lines that still begin or end with white space
    for _ in range(STEPS):
        alive = alive[~SOLID[raw[lo[alive]]]]
        lo[alive] += 1
        alive = alive[lo[alive] < hi[alive]]
    long_head, alive = alive, np.flatnonzero(lo < hi)
    for _ in range(STEPS):
        alive = alive[~SOLID[raw[hi[alive] - 1]]]
        hi[alive] -= 1
        alive = alive[lo[alive] < hi[alive]]
    if len(long_head) or len(alive):
        solid = np.concatenate([np.flatnonzero(SOLID[raw]), [len(raw)]])
        lo[long_head] = np.minimum(solid[np.searchsorted(solid, lo[long_head])], ends[long_head])
        hi[alive] = np.maximum(np.concatenate([[-1], solid])[np.searchsorted(solid, hi[alive])] + 1, lo[alive])
        hi = np.maximum(hi, lo)
    return lo, hi


def _points(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Code points of each span."""
    if not len(lo):
        return np.zeros(0, np.int64)
    total = np.zeros(len(raw) + 1, np.int32)
    np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32, out=total[1:])
    return (total[hi] - total[lo]).astype(np.int64)


def line_keys(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Distinct ``(doc, h1, h2)`` of the lines whose key has ``min_chars`` code points or more; rows without an id have none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, first, h1, h2, chars = _lines(part.column("text"))
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                use = chars >= min_chars
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(row[use])), pa.array(signed(h1[use])), pa.array(signed(h2[use]))], ["doc", "h1", "h2"])

    given = docs.select(named(id_col).cast("long").alias("doc"), named(text_col).cast("string").alias("text")).where("doc is not null")
    return given.mapInArrow(scan, "doc long, h1 long, h2 long")


def drop_shared_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, counts: bool = True) -> DataFrame:
    """``docs`` without the lines that ``min_docs`` documents or more share, but for the smallest id that holds one.

    A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased. Keys shorter than
    ``min_chars`` code points are never dropped. What stays is joined by a newline. ``counts`` adds ``n_lines`` and
    ``n_dropped`` (columns of these names are replaced). A column ``n_chars``, if there, follows the new text.

    Null or empty text: one empty line, kept (the text becomes empty). Rows without an id keep all lines and count for
    nothing. Rows that share an id count as one document. Empty input: empty output. Other columns, of any names, pass
    through.

    Plan: keys travel as 128-bit hashes and are written once; a hash's documents are counted with a map-side combine, so
    a line that is in every document adds one row a task. The join back is on hashes, but for those that have more than
    1 / ``FREQUENT`` of all lines, which are broadcast: fewer than ``FREQUENT`` can. Texts are shuffled once.
    """
    keys = written(line_keys(docs, id_col=id_col, text_col=text_col, min_chars=min_chars), "keys")
    if min_docs == 2:
        shared = keys.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("rows")).where("least < most").drop("most")
    else:
        seen = keys.groupBy("h1", "h2", "doc").agg(F.count("*").alias("rows"))
        shared = seen.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.count("*").alias("n"), F.sum("rows").alias("rows")).where(F.col("n") >= min_docs).drop("n")
    shared = written(shared, "shared")
    frequent = F.col("rows") > keys.count() / FREQUENT
    hot = F.broadcast(shared.where(frequent).select("h1", "h2", "least"))  # at most ``FREQUENT`` rows, whatever the table
    rare = keys.join(hot, ["h1", "h2"], "left_anti").join(shared.where(~frequent).select("h1", "h2", "least"), ["h1", "h2"])
    later = keys.join(hot, ["h1", "h2"]).unionByName(rare).where("doc > least")
    drops = later.groupBy(F.col("doc").alias("dropped_from")).agg(F.collect_set("h1").alias("drops"))
    names = [n for n in docs.columns if n not in ("n_lines", "n_dropped") or not counts]
    others = [n for n in names if n != text_col]
    rest = F.struct(*[named(n).alias(n) for n in others])  # all other columns in one, so that no name of theirs matters here
    base = docs.select(named(id_col).cast("long").alias("doc"), named(text_col).cast("string").alias("body"), rest.alias("rest"))
    schema = T.StructType([base.schema["body"], base.schema["rest"]]).add("n_lines", "long").add("n_dropped", "long")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                text = part.column("body")
                raw, _ = text_bytes(text)
                starts, ends, first, h1, _, chars = _lines(text)
                keep = np.ones(len(starts), bool)
                h1, long_enough, hit = signed(h1), chars >= min_chars, part.column("drops")
                for i in np.flatnonzero(np.asarray(hit.is_valid())):
                    own = slice(first[i], first[i + 1])
                    keep[own] = ~(np.isin(h1[own], hit[int(i)].values.to_numpy(zero_copy_only=False)) & long_enough[own])
                kept, data = [], raw.tobytes()
                for i in range(part.num_rows):
                    own = range(first[i], first[i + 1])
                    whole = keep[first[i] : first[i + 1]]
                    kept.append(data[starts[own[0]] : ends[own[-1]]] if whole.all() else b"\n".join(data[starts[j] : ends[j]] for j in own if keep[j]))
                texts = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([texts, part.column("rest"), pa.array(np.diff(first)), pa.array(run_sum(~keep, first))], schema.names)

    joined = base.join(drops, F.col("doc") == F.col("dropped_from"), "left").select("body", "rest", "drops")
    back = {text_col: F.col("body")} | {n: F.col("rest").getField(n) for n in others}
    if "n_chars" in others:
        back["n_chars"] = F.char_length("body").cast(docs.schema["n_chars"].dataType)
    return joined.mapInArrow(rebuild, schema).select(*[back[n].alias(n) for n in names], *["n_lines", "n_dropped"] * counts)
