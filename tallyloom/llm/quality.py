"""A document quality score: random-indexing word vectors, pooled, through a small two-layer network with a fitted temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyloom.llm.bytescan import U64, release, row_of, slices, span_hashes, spans, text_bytes
from tallyloom.llm.columns import named
from tallyloom.llm.scratch import tidy, written

#: Words share this many vectors by hash; looks (see ``_looks``) have one each.
WORDS, LOOKS, DIMS, NONZERO, REACH = 1 << 14, 1 << 12, 64, 8, 2

#: Bytes of text whose word vectors are held at once, some 40 times as large.
STEP = 512 << 10


def index_vectors(n: int, seed: int) -> np.ndarray:
    """``n`` sparse random vectors of ``DIMS``: ``NONZERO`` places hold 1 or -1, scaled to length 1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIMS), np.float32)
    at = np.argsort(rng.random((n, DIMS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice([-1.0, 1.0], (n, NONZERO)).astype(np.float32), 1)
    return out / np.float32(NONZERO**0.5)


def _terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its vector's number and its look's, and each row's first word."""
    raw, offsets = text_bytes(col)
    starts, ends, first = spans(raw, offsets)
    hashed = span_hashes(raw, starts, ends)
    return (hashed & U64(WORDS - 1)).astype(np.int64), _looks(raw, starts, ends, hashed, first), first


def _looks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What a word looks like, as a number below ``LOOKS``: kinds of characters, length, whether it repeats the last word."""

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[ends] - total[starts]

    if not len(starts):
        return np.zeros(0, np.int64)
    upper = count((raw >= 0x41) & (raw <= 0x5A))
    lower = count((raw >= 0x61) & (raw <= 0x7A))
    digit = count((raw >= 0x30) & (raw <= 0x39))
    size = ends - starts
    wide = count(raw >= 0x80)
    mark = size - upper - lower - digit - wide
    again = np.zeros(len(starts), np.int64)
    again[1:] = hashed[1:] == hashed[:-1]
    heads = first[:-1][first[:-1] < len(starts)]
    again[heads] = 0
    grade = np.searchsorted([2, 4, 8, 16, 32, 64, 128], size, "right")
    parts = ((np.minimum(upper, 3), 4), (np.minimum(lower, 2), 3), (np.minimum(mark, 3), 4), ((digit > 0).astype(np.int64), 2), ((wide > 0).astype(np.int64), 2), (again, 2), (grade, 8))
    out = np.zeros(len(starts), np.int64)
    for value, n in parts:
        out = out * n + value
    return out


def _contexts(numbers: np.ndarray, row: np.ndarray, index: np.ndarray, into: np.ndarray) -> None:
    """Adds to ``into``, for each term, the index vectors of the terms up to ``REACH`` places away in the same row."""
    n = len(index)
    for step in range(1, REACH + 1):
        same = row[:-step] == row[step:]
        a, b = numbers[:-step][same], numbers[step:][same]
        pairs, often = np.unique(np.concatenate([a * n + b, b * n + a]), return_counts=True)
        for lo in range(0, len(pairs), 1 << 17):
            p, k = pairs[lo : lo + (1 << 17)], often[lo : lo + (1 << 17)].astype(np.float32)
            own = p // n
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            into[own[heads]] += np.add.reduceat(index[p % n] * k[:, None], heads)


def _vectors(contexts: np.ndarray, index: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(contexts, axis=1, keepdims=True)
    return (index + contexts / np.where(length > 0, length, 1)).astype(np.float32)


def _pooled(col: pa.Array, words: np.ndarray, looks: np.ndarray) -> np.ndarray:
    """A row each: the mean word vector, the mean look vector and the logarithm of the number of words."""
    word, look, first = _terms(col)
    n = len(first) - 1
    sums = np.zeros((n, 2 * DIMS), np.float32)
    count = np.diff(first)
    some = np.flatnonzero(count)
    if len(some):
        sums[some, :DIMS] = np.add.reduceat(words[word], first[some])
        row = row_of(first)
        pairs, often = np.unique(row * LOOKS + look, return_counts=True)
        own = pairs // LOOKS
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sums[own[heads], DIMS:] = np.add.reduceat(looks[pairs % LOOKS] * often.astype(np.float32)[:, None], heads)
    return np.hstack([sums / np.maximum(count, 1)[:, None], np.log1p(count)[:, None]]).astype(np.float32)


@dataclass
class QualityModel:
    """All that a score needs; the size does not depend on the corpus."""

    words: np.ndarray
    looks: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def parts(self) -> tuple:
        return self.words, self.looks, self.shift, self.scale, self.layers, self.temperature


def _output(scaled_rows: np.ndarray, layers: tuple) -> np.ndarray:
    first, bias, second, last = layers
    return np.tanh(scaled_rows @ first + bias) @ second + last


def _logits(pooled: np.ndarray, shift: np.ndarray, scale: np.ndarray, layers: tuple) -> np.ndarray:
    return _output((pooled - shift) / scale, layers)


def _in_order(pooled: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Labels and vectors (in doubles) of rows (doc, y, x), by doc, then by the vector's bytes. Held once as bytes and once as doubles."""
    width = 2 * DIMS + 1
    raw, _ = text_bytes(pooled.column("x").combine_chunks())
    order = np.lexsort((raw.view(f"S{4 * width}"), pooled.column("doc").to_numpy()))
    return pooled.column("y").to_numpy()[order], raw.view(np.float32).reshape(-1, width)[order].astype(np.float64)


def _scores(pooled: np.ndarray, parts: tuple) -> np.ndarray:
    _, _, shift, scale, layers, temperature = parts
    return 1.0 / (1.0 + np.exp(-np.clip(_logits(pooled, shift, scale, layers) / temperature, -60, 60)))


def train_network(x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Two layers (tanh, logistic) by Adam on shuffled batches; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            i = order[lo : lo + 256]
            h = np.tanh(x[i] @ p[0] + p[1])
            err = weight[i] * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - y[i]) / len(i)
            back = np.outer(err, p[2]) * (1 - h * h)
            grads = [x[i].T @ back + decay * p[0], back.sum(0), h.T @ err + decay * p[2], np.array([err.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits at which held-back labels are likeliest."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(20), 200))
    z = logits[None, :] / grid[:, None]
    loss = np.logaddexp(0, np.where(y == 1, -z, z)).mean(1)
    return float(grid[loss.argmin()])


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", usable: Column | None = None, sample: int = 12_000) -> QualityModel:
    """A model from labelled rows, on a sample of about ``sample`` of them at most, drawn by a hash of the id.

    ``usable`` says which rows of ``labels`` may be learned from. Null ids and labels are left out; of several labels of
    an id the larger counts. With one class or none, all scores are that class (or 1). The sample is all that is joined, read twice (contexts, then pooled vectors)
    and of which pooled vectors, a few hundred bytes a row, go to the driver; its bound does not depend on the corpus.
    Word vectors: each word's sum of its neighbours' random index vectors over the sample, beside its own.
    """
    spark = docs.sparkSession
    known = labels.where(usable if usable is not None else F.lit(True)).select(named(id_col).cast("long").alias("__doc"), named(label_col).cast("int").alias("__y")).where("__doc is not null and __y in (0, 1)")
    known = known.groupBy("__doc").agg(F.max("__y").alias("__y"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("__doc", F.lit("quality")), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30))))
    rows = docs.select(named(id_col).cast("long").alias("__doc"), named(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "__doc")  # at most about ``sample`` rows
    rows = written(rows.select("__doc", "text", "__y").repartition(6, "__doc").sortWithinPartitions("__doc", "text"), "sample")
    word_index, look_index = index_vectors(WORDS, 11), index_vectors(LOOKS, 12)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_sum, look_sum = np.zeros((WORDS, DIMS), np.float32), np.zeros((LOOKS, DIMS), np.float32)
        own_words, own_looks, least = index_vectors(WORDS, 11), index_vectors(LOOKS, 12), 1 << 62
        for batch in batches:
            for part in slices(batch, "text"):
                word, look, first = _terms(part.column("text"))
                row = row_of(first)
                _contexts(word, row, own_words, word_sum)
                _contexts(look, row, own_looks, look_sum)
                least = min(least, *part.column("__doc").to_pylist())
        if least < 1 << 62:  # a task without rows adds nothing
            yield pa.RecordBatch.from_arrays([pa.array([least]), pa.array([word_sum.tobytes()], pa.binary()), pa.array([look_sum.tobytes()], pa.binary())], ["least", "words", "looks"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_sum, look_sum = np.zeros((WORDS, DIMS)), np.zeros((LOOKS, DIMS))
        for batch in batches:
            for k in range(batch.num_rows):
                word_sum += np.frombuffer(batch.column("words")[k].as_buffer(), np.float32).reshape(WORDS, DIMS)
                look_sum += np.frombuffer(batch.column("looks")[k].as_buffer(), np.float32).reshape(LOOKS, DIMS)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (word_sum, look_sum)], ["words", "looks"])

    # sums of a fixed size, one a task over the bounded sample, are added up in one task: the driver gets a single row
    parts = rows.mapInArrow(contexts, "least long, words binary, looks binary")
    total = parts.repartition(1).sortWithinPartitions("least").mapInArrow(add, "words binary, looks binary").first()
    word_sum = np.frombuffer(total.words, np.float32).reshape(WORDS, DIMS).astype(np.float64) if total else np.zeros((WORDS, DIMS))
    look_sum = np.frombuffer(total.looks, np.float32).reshape(LOOKS, DIMS).astype(np.float64) if total else np.zeros((LOOKS, DIMS))
    del total
    words, looks = _vectors(word_sum, word_index), _vectors(look_sum, look_index)
    del word_sum, look_sum, word_index, look_index
    release()  # the driver's heap is full of what vectors were made of
    held = spark.sparkContext.broadcast((words, looks))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                pooled = _pooled(part.column("text"), *held.value)
                yield pa.RecordBatch.from_arrays([part.column("__doc"), part.column("__y"), pa.array([x.tobytes() for x in pooled], pa.binary())], ["doc", "y", "x"])

    y, x = _in_order(rows.mapInArrow(pool, "doc long, y int, x binary").toArrow())  # the sample, pooled
    held.destroy()
    if len(set(y.tolist())) < 2:
        width = 2 * DIMS + 1
        return QualityModel(words, looks, np.zeros(width), np.ones(width), (np.zeros((width, 1)), np.zeros(1), np.zeros(1), -9.0 if len(y) and y[0] == 0 else 9.0), 1.0)
    shift, scale = x.mean(0), x.std(0) + 1e-6
    x -= shift
    x /= scale
    back = np.arange(len(x)) % 5 == 4  # held back for the temperature
    if len(set(y[back].tolist())) < 2 or len(set(y[~back].tolist())) < 2:
        back = np.zeros(len(x), bool)
    tidy(spark)
    release()  # what came with the rows, before training takes memory of its own
    layers = train_network(x[~back], y[~back])
    use = back if back.any() else ~back
    return QualityModel(words, looks, shift, scale, layers, fit_temperature(_output(x[use], layers), y[use]))


def scored(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the probability of label 1 from the whole text (a string column) alone (replaced if there).

    Null and empty texts are scored as texts of no words. A pass over the rows without a shuffle; the model, some 5 MB
    whatever the corpus, is broadcast.
    """
    keep = [n for n in docs.columns if n != score_col]
    inner = [f"c{i}" for i in range(len(keep))]  # names that cannot clash with each other
    release()  # what fitting held on the driver
    held = docs.sparkSession.sparkContext.broadcast(model.parts())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = held.value
        for batch in batches:
            for part in slices(batch, body, STEP):
                scores = _scores(_pooled(part.column(body), parts[0], parts[1]), parts)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in inner), pa.array(scores.astype(np.float64))], [*inner, "score"])

    body = inner[keep.index(text_col)]
    given = docs.select(*[named(n).alias(i) for n, i in zip(keep, inner, strict=True)])
    done = given.mapInArrow(score, T.StructType(list(given.schema.fields)).add("score", "double"))
    return done.select(*[F.col(i).alias(n) for n, i in zip(keep, inner, strict=True)], F.col("score").alias(score_col))
