import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import mixing, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def corpus(n=900):
    rng = random.Random(9)
    out = [(i, " ".join(["w"] * int(rng.lognormvariate(4, 1.2))), rng.choice(["a", "a", "a", "b", "ç", "d", None, ""])) for i in range(n)]
    return [*out, (n, None, "a"), (n + 1, "", "only empty"), (None, "no id here", "b"), (5, "again", "a"), (n + 2, "w " * 30_000, "b")]


def test_mix_meets_targets(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
    assert sorted(r.size for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _ in rows)
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 5)
    again = {(r.doc_id, r.size): r.copies for r in mixing.mixed(df.repartition(3)).collect()}
    assert sum(again[r.doc_id, r.size] != r.copies for r in got) <= 2 * len(sizes)  # ties of equal size alone


def test_rates_are_tilted_exponentially(spark):
    sizes = spark.createDataFrame([("a", s, 10) for s in range(1, 60)], "source string, size long, n long")
    total = 10 * sum(range(1, 60))
    for aim in (0.2, 0.9, 1.0, 1.3, 1.9):
        goal = spark.createDataFrame([("a", total, aim * total)], "source string, source_size long, target double")
        r = mixing.tilt(sizes, goal, cap=2).first()
        got = sum(10 * s * min(2.0, np.exp(r.tilt * s / r["mean"])) for s in range(1, 60))
        assert abs(got - aim * total) < 1e-4 * total


def test_mixed_documents_repeat_rows(spark):
    df = spark.createDataFrame([(i, "one two three", "s", "x") for i in range(10)], "doc_id long, text string, source string, __other string")
    out = mixing.mixed_documents(df, share=1.5)
    assert out.columns == df.columns and out.count() == 15
    assert mixing.mixed_documents(df.where("false")).count() == 0 and mixing.mixed(df.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_item_without_overlap(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 1024])
    sizes = [rng.choice([rng.randrange(1, capacity + 1), rng.randrange(1, capacity // 3 + 1)]) for _ in range(rng.choice([0, 1, 50, 2000]))]
    counts = collections.Counter(sizes)
    bins, used = collections.defaultdict(list), collections.Counter()
    for size, lo, hi, first, each, offset in packing.plan_bins(counts, capacity):
        for r in range(lo, hi):
            bins[first + (r - lo) // each].append((offset + size * ((r - lo) % each), size))
            used[size, r] += 1
    assert used == collections.Counter((s, r) for s in counts for r in range(counts[s]))
    for items in bins.values():
        at = 0
        for o, s in sorted(items):
            assert o == at
            at += s
        assert at <= capacity and sum(3 * s > capacity for _, s in items) <= 2
    assert len(bins) <= 1.1 * sum(sizes) / capacity + sum(2 * s > capacity for s in sizes) + 2


def test_pieces_are_those_of_the_tokenizer(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "Ünï çödé 日本語 🙂", "<|endoftext|> in a text", "  spaces\n\n\tand tabs ", "don't won't 123 4567", "x" * 5000, "word " * 1023, "word " * 1024]
    texts += [" ".join("".join(rng.choice("abcdeéß ") for _ in range(9)) for _ in range(rng.randrange(900))) for _ in range(25)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0), (None, "no id", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack_documents(df).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        cut = piece = 0
        while cut < len(ids):
            n = (len(ids) - cut) % 1024 or 1024
            data = np.array(ids[cut : cut + n], "<u4").tobytes()
            want[i, piece, cut, n, zlib.crc32(data), data] += 1
            cut, piece = cut + n, piece + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(df.where("false")).count() == 0


def test_very_long_runs_are_encoded_like_the_tokenizer():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    encode, tokenizer = packing._encoder(vocabulary, public_tokenizers.PATTERN), Tokenizer.from_str(vocabulary)
    rng = random.Random(5)
    letters = "aé日🙂 \n\t\u3000\u00a01,.'<|>"
    texts = [" " * 1_000_000, "\n" * 1_000_000, "a" + " " * 600_000 + "b", "x" * 300_000, "1" * 200_000, "日本語" * 70_000, "\u3000" * 150_000, "<|endoftext|>" + " " * 120_000 + "it's", " " * (packing._LONG_RUN - 1)]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for n in (0, 1, 50, 3000, 150_000)]
    for t in texts:
        assert encode(t) == tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_of_blanks_and_of_clashing_names(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000, 1), (None, None, 2)], "`doc.id` long, text string, unit int")
    got = packing.pack_documents(df, id_col="doc.id")
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(" " * 1_000_000, add_special_tokens=False).ids
    assert got.columns[0] == "doc.id" and sum(r.length for r in got.collect()) == len(ids) + 2  # and an end for each
