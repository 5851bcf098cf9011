import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import order_minhash as m

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
PLACE = (1 << 28) - 1


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def h(data, seed=42):
    return signed(xxhash.xxh64_intdigest(data, seed & ((1 << 64) - 1)))


def hl(x, seed=42):
    return h((x & ((1 << 64) - 1)).to_bytes(8, "little"), seed)


def hi(x, seed=42):
    return h(x.to_bytes(4, "little"), seed)


def signature(text, bits=6):
    words = [h(w.encode()) for w in SPLIT.findall(text)]
    grams = [hl(b, hl(a)) for a, b in zip(words[:-1], words[1:], strict=True)] or [hl(w) for w in words]
    seen, items = {}, []
    for place, g in enumerate(grams):
        k = g >> 28
        o = seen.get(k, 0)
        seen[k] = o + 1
        items.append(((hi(o, hl(k)) & ~PLACE) | place))
    bins = {}
    for x in sorted(items):
        bins.setdefault((x & ((1 << 64) - 1)) >> (64 - bits), []).append(x)
    out = []
    for b, xs in bins.items():
        xs = sorted(xs[:2], key=lambda x: x & PLACE)
        seed = 42
        for x in xs:
            seed = hl(x >> 28, seed)
        out.append(b << 32 | (seed & 0xFFFFFFFF))
    return set(out)


def like(a, b):
    bins = {x >> 32 for x in a | b}
    return len(a & b) / len(bins) if bins else 1.0


def rows():
    rng = random.Random(6)
    words = ["ab", "cd", "é", "x1", "the", "of", "zz"]
    out = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 60, 400]))), "k") for i in range(40)]
    return [*out, (1000, None, "k"), (1001, "", "k"), (1002, " \n\t", "k"), (1003, "𝄞é𝄞 ab\ncd", "k"), (1004, "same " * 3000, "k"), (1005, out[9][1], "k"), (-5, "below zero", "k")]


def test_like_brute_force(spark):
    given = rows()
    texts = {i: t or "" for i, t, _ in given}
    order = sorted(texts, reverse=True)
    df = spark.createDataFrame(given, "doc_id long, text string, fingerprint string")
    got = m.fingerprinted(df, filled=False).collect()
    assert len(got) == len(given)
    for r in got:
        t, n = texts[r.doc_id], len(texts[r.doc_id])
        after = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        edited = t[: n - n // 2] + after[: n // 2]
        assert (r.n_chars, r.edited) == (n, edited)
        one, two = signature(t), signature(edited)
        assert r.fingerprint == "".join(f"{x:010x}" for x in sorted(one, key=lambda x: (x >> 32) ^ 32))
        assert abs(r.near_edited - like(one, two)) < 1e-12 and abs(r.near_next - like(one, signature(after))) < 1e-12


def test_next_crosses_ranges_and_wraps(spark):
    ids = [1, 2, 3, 50, 51, 900, 10**12, -(10**15)]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "id long, t string")
    order = sorted(ids, reverse=True)
    for a_bucket in (1, 2, 256):
        got = {r.id: r.n for r in m.with_next(df, id_col="id", columns={"n": "t"}, rows_a_bucket=a_bucket).collect()}
        assert got == {i: str(order[(k + 1) % len(order)]) for k, i in enumerate(order)}


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, None), (7, "a b"), (7, "a b"), (7, "c d")], "doc_id long, text string")
    out = m.fingerprinted(df, filled=False).collect()
    assert len(out) == 5 and all(r.edited == r.text[: len(r.text) - len(r.text) // 2] for r in out if r.doc_id is None)
    assert m.fingerprinted(df.where("false"), filled=False).count() == 0
    one = m.fingerprinted(spark.createDataFrame([(1, "abcd")], "doc_id long, text string"), filled=False).first()
    assert one.edited == "abab" and hashlib.sha256(b"abab").hexdigest()


def test_order_counts(spark):
    words = [f"w{i}" for i in range(400)]
    base, turned, other = " ".join(words), " ".join(words[200:] + words[:200]), " ".join(f"v{i}" for i in range(400))
    df = m.with_signature(spark.createDataFrame([(base, turned, other)], "a string, b string, c string"), "a", "sa")
    df = m.with_signature(m.with_signature(df, "b", "sb"), "c", "sc")
    near, far = df.select(m.likeness(F.col("sa"), F.col("sb")), m.likeness(F.col("sa"), F.col("sc"))).first()
    assert far < 0.05 < near < 0.95  # the same word pairs but for one, in another order
