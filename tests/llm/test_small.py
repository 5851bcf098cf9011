"""Helpers shared by the corpus operators."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import bytescan as b
from tallyloom.llm.components import components
from tallyloom.llm.substring_dedup import cover_for


def test_words_are_runs_without_ascii_white_space_and_stop_at_rows():
    texts = ["a b", "", None, "  x y \n\tz", "q", "é\x0bf\x1fg"]
    raw, off = b.text_bytes(pa.array(texts))
    starts, ends, first = b.spans(raw, off)
    got = [raw.tobytes()[s:e].decode() for s, e in zip(starts, ends, strict=True)]
    assert got == ["a", "b", "x y", "z", "q", "é", "f\x1fg"] and first.tolist() == [0, 2, 2, 2, 4, 5, 7]
    sliced = pa.array(["zz", *texts]).slice(1)
    assert b.spans(*b.text_bytes(sliced))[2].tolist() == first.tolist()


def test_hashes_depend_on_the_text_alone():
    words = ["", "a", "abcdefgh", "abcdefghi", "x" * 100_000, "abcdefg\0", "abcdefg"]
    alone = [b.word_hashes(pa.array([w]))[0].tolist() for w in words if w]
    together = b.word_hashes(pa.array([" ".join(w for w in words if w)]))[0].tolist()
    assert [x[0] for x in alone] == together and len(set(together)) == len(together)
    w = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert b.window_hashes(np.concatenate([w, w]), 20)[0] == b.window_hashes(np.concatenate([w, w]), 20)[59]


def test_slices_take_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 5, 100, 1, 1, 1, 50, 0)])], ["t"])
    parts = [p.column("t").to_pylist() for p in b.slices(batch, "t", limit=10)]
    assert sum(parts, []) == batch.column("t").to_pylist() and max(sum(map(len, p)) for p in parts if len(p) > 1) <= 10


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 20, 50, 64])
def test_covers_align_any_two_places(window):
    period, cover, anchor = cover_for(window)
    for i in range(period):
        for j in range(period):
            assert any((i + k) % period in cover and (j + k) % period in cover and k + anchor <= window for k in range(period))


def test_components_are_those_of_union_find(spark):
    rng = random.Random(5)
    for n, m in ((0, 0), (2, 1), (60, 40), (200, 260)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(20)] if n > 30 else [])
        up = list(range(max(n, 1)))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in links:
            x, y = find(x), find(y)
            up[max(x, y)] = min(x, y)
        got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {x: find(x) for pair in links for x in pair if pair[0] != pair[1] or any(x in p and p[0] != p[1] for p in links)}
