import random
import re

import pytest

from tallyloom.llm import ngram_join
from tallyloom.llm.prefix_tree import build, matches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if i is not None and j is not None and s and u and den * len(s & u) >= num * len(s | u):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def rows():
    rng = random.Random(8)
    words = [f"Wörd{i}" for i in range(300)]
    line = " ".join(rng.choice(words) for _ in range(12))
    out = []
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 10, 40, 90]))]
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append((len(out), " ".join(own) + (" " + line if family % 3 == 0 else "")))
    out += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "one two"), (None, "one"), (506, "one"), (7, out[20][1]), (507, " ".join(["a"] * 5000)), (508, "a a a a a a"), (509, " ".join(f"x{i}" for i in range(9000)))]
    out.append((510, out[-1][1] + " y z"))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("n", "num", "den", "block"), [(3, 90, 100, 1024), (5, 4, 5, 1024), (3, 1, 2, 3), (2, 1, 1, 1024)])
def test_like_brute_force(spark, monkeypatch, n, num, den, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    given = rows()
    df = spark.createDataFrame([(i, t, 1) for i, t in given], "doc_id long, text string, component_id int")
    got = ngram_join.jaccard_components(df, n=n, threshold=(num, den))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(given, n, num, den)


def test_common_shingles_do_not_link(spark):
    line = " ".join(f"c{i}" for i in range(30))
    given = [(i, line + " " + " ".join(f"d{i}x{k}" for k in range(40))) for i in range(120)]
    got = ngram_join.jaccard_components(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got)


def test_one_of_each_component_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    given = [(3, text, "a"), (5, text + " x", "b"), (9, "other words than these here", "c"), (None, text, "d"), (10, None, "e"), (3, text, "f")]
    out = ngram_join.drop_near_copies(spark.createDataFrame(given, "doc_id long, text string, lang string"))
    assert sorted(r.lang for r in out.collect()) == ["a", "c", "d", "e", "f"] and out.columns == ["doc_id", "text", "lang"]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(empty).count() == 0 and ngram_join.drop_near_copies(empty).count() == 0


def test_tree_finds_all_matches():
    import numpy as np

    rng = random.Random(1)
    members = sorted(sorted(rng.sample(range(40), rng.randrange(1, 25))) for _ in range(80))
    root = build([np.array(m, np.int32) for m in members])
    for probe in members:
        need = lambda size, p=probe: max(1, (len(p) + size) // 3)
        got = {i: s for i, s in matches(root, np.array(probe, np.int32), np.isin(np.arange(40), probe), np.arange(len(members) + 1), need)}
        want = {i: len(set(m) & set(probe)) for i, m in enumerate(members) if len(set(m) & set(probe)) >= need(len(m))}
        assert got == want


@pytest.mark.parametrize("items", [50, 2000])
def test_blocks_by_items(spark, monkeypatch, items):
    monkeypatch.setattr(ngram_join, "ITEMS", items)
    given = rows()
    got = ngram_join.jaccard_components(spark.createDataFrame(given, "doc_id long, text string"), n=3, threshold=(1, 2))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(given, 3, 1, 2)


def test_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(100))
    names = ["gone", "__gone", "component_id", "a.b", "doc", "n_shingles"]
    df = spark.createDataFrame([(3, text, *range(6)), (5, text + " x", *range(6)), (None, None, *[None] * 6)], "doc_id int, text string, " + ", ".join(f"`{n}` long" for n in names))
    out = ngram_join.drop_near_copies(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0) for r in out.collect()) == [0, 3]
