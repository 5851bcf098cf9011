"""Runs of equal keys in a sorted stream of record batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows that agree in ``keys`` (non-null longs), from batches in which such rows stand together.

    A group may cross batches; one group at a time is held.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def close() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(int(c[lo]) for c in columns)
            if held and key != last:
                yield close()
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield close()


def pieces(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows, in order, that agree in ``keys``; a group may make many parts."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def close() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(int(c[lo]) for c in columns)
            while lo < hi:
                have = sum(b.num_rows for b in held)
                if held and (key != last or have >= rows):
                    yield close()
                    held, have = [], 0
                n = min(hi - lo, rows - have)
                held.append(batch.slice(lo, n))
                last, lo = key, lo + n
    if held:
        yield close()


class Sets:
    """Disjoint sets over 0..n-1 whose root is the least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
