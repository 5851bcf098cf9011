import random

import pytest
from pyspark.sql import functions as F
from test_minhash import SPLIT, h, hi, hl, like

from tallyloom.llm import order_minhash as m

WIDE = (1 << 28) - 1


def signature(words):
    """For each bin the two items that come first from its start on, around the circle of hashes."""
    words = [h(w.encode()) for w in words]
    grams = [hl(b, hl(a)) for a, b in zip(words[:-1], words[1:], strict=True)] or [hl(w) for w in words]
    seen, items = {}, []
    for place, g in enumerate(grams):
        o = seen.get(g >> 28, 0)
        seen[g >> 28] = o + 1
        items.append((hi(o, hl(g >> 28)) & ~WIDE) | place)
    out = set()
    for b in range(64 if items else 0):
        two = sorted(items, key=lambda x: (x - (b << 58)) & ((1 << 64) - 1))[:2]
        seed = 42
        for x in sorted(two, key=lambda x: x & WIDE):
            seed = hl(x >> 28, seed)
        out.add(b << 32 | (seed & 0xFFFFFFFF))
    return out


def likenesses(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = m.with_signature(m.with_signature(df, "a", "sa", filled=True), "b", "sb", filled=True)
    return df.select("sa", "sb", m.likeness(F.col("sa"), F.col("sb")).alias("near")).orderBy("i").collect()


def test_filled_like_brute_force(spark):
    rng = random.Random(4)
    words = ["ab", "cd", "é", "x1", "the", "of", "zz", *map(str, range(90))]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 2, 3, 4, 10, 20, 40, 60, 400)]
    got = likenesses(spark, list(zip(texts, texts[1:] + texts[:1], strict=True)))
    for r, a, b in zip(got, texts, texts[1:] + texts[:1], strict=True):
        one, two = signature(SPLIT.findall(a)), signature(SPLIT.findall(b))
        assert set(r.sa) == one and len(r.sa) == len(one) and abs(r.near - like(one, two)) < 1e-12
        assert [x >> 32 for x in r.sa] == ([*range(32, 64), *range(32)] if one else [])


@pytest.mark.parametrize("n", [10, 20, 40, 60])
def test_order_counts_in_short_texts(spark, n):
    pairs = []
    for k in range(60):
        w = [f"w{k}x{i}" for i in range(n)]
        pairs.append((" ".join(w), " ".join(w[n // 2 :] + w[: n // 2])))
    near = [r.near for r in likenesses(spark, pairs)]
    assert 0.2 < sum(near) / len(near) < 0.62  # a third (10 words) to a half of all pairs of items stay on one side


def test_texts_without_white_space(spark):
    rng = random.Random(5)
    text = lambda low, high, n: "".join(chr(rng.randrange(low, high)) for _ in range(n))
    for low, high in ((0x4E00, 0x5E00), (97, 123)):
        a, b = text(low, high, 600), text(low, high, 600)
        same, half, none = (r.near for r in likenesses(spark, [(a, a), (a, a[:300] + b[:300]), (a, b)]))
        assert same == 1 and 0.02 < half < 0.5 and none < 0.02
    short = likenesses(spark, [("今天天气很好我们去公园", "今天天气很好他们回家了")])[0]
    assert 0 < short.near < 1
    pieces = lambda w: [w[i : i + 3] for i in range(len(w) - 2)]
    url = "http://example.org/a/long/path"
    got = likenesses(spark, [(f"see {url} now", "日本語のテキスト ok")])[0]
    assert set(got.sa) == signature(["see", *pieces(url), "now"]) and set(got.sb) == signature([*pieces("日本語のテキスト"), "ok"])


def test_ranges_hold_as_many_rows_each_beside_far_ids(spark):
    ids = [-(2**63), *range(3000), 2**62, 2**63 - 1]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "id long, t string")
    order = sorted(ids, reverse=True)
    got = m.with_next(df, id_col="id", columns={"n": "t"}, rows_a_bucket=100)
    assert {r.id: r.n for r in got.collect()} == {i: str(order[(k + 1) % len(order)]) for k, i in enumerate(order)}
    at = df.select(m._place_in(F.col("id"), [0, 10, 20]).alias("b")).groupBy("b").count().collect()
    assert {r.b: r["count"] for r in at} == {0: 1, 1: 10, 2: 10, 3: 2982}


def test_one_very_long_unspaced_run_by_default(spark):
    rng = random.Random(5)
    run = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    edited = run[:50_000] + "x" + run[50_000:]
    df = spark.createDataFrame([(run, edited)], "a string, b string")
    got = m.with_signature(m.with_signature(df, "a", "sa"), "b", "sb").select("sa", m.likeness(F.col("sa"), F.col("sb")).alias("near")).first()
    assert len(got.sa) == 64 and got.near > 0.9
