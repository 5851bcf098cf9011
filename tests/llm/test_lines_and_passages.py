import random
import re

import pytest

from tallyloom.llm.line_dedup import drop_shared_lines
from tallyloom.llm.substring_dedup import drop_repeated_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, min_chars=10, min_docs=2):
    key = lambda line: line.strip(WHITE).translate(LOW)
    where = {}
    for i, t in rows:
        if i is not None:
            for k in {key(x) for x in (t or "").split("\n")}:
                where.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [i is not None and len(key(x)) >= min_chars and len(where[key(x)]) >= min_docs and i > min(where[key(x)]) for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)))
    return sorted(out, key=str)


def brute_passages(rows, window):
    starts = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                starts[k] = min(starts.get(k, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        if i is not None:
            for p in range(len(w) - window + 1):
                if starts[tuple(w[p : p + window])] < i:
                    gone[p : p + window] = [True] * window
        out.append((i, " ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone)))
    return sorted(out, key=str)


def run(df, cols):
    return sorted(((r.doc_id, r.text, r[cols[0]], r[cols[1]]) for r in df.collect()), key=str)


SHARED = ["The same line here.", "  the SAME line here.\t", "ÄÖÜ äöü ßßß", "short", " kept white space", "x" * 9, "y" * 10]


def line_rows():
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice([*SHARED, f"own line {i} {rng.randrange(9)}", ""]) for _ in range(rng.randrange(6)))) for i in range(60)]
    return [*rows, (100, None), (101, ""), (None, SHARED[0]), (5, SHARED[0]), (5, SHARED[0]), (102, "\n\n"), (103, SHARED[0] * 20_000), (104, "é" * 9 + "\n" + "é" * 10), (105, "é" * 10), (106, "tail\n" + SHARED[6])]


def test_lines_like_brute_force(spark):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(drop_shared_lines(df), ("n_lines", "n_dropped")) == brute_lines(rows)
    assert run(drop_shared_lines(df, min_docs=3, min_chars=5), ("n_lines", "n_dropped")) == brute_lines(rows, 5, 3)


def test_lines_keep_other_columns(spark):
    df = spark.createDataFrame([(1, SHARED[0], "en", 99, 7), (2, SHARED[0] + "\nmore", "fr", 99, 7)], "doc_id int, text string, lang string, n_chars long, n_lines int")
    out = drop_shared_lines(df)
    assert [tuple(r) for r in out.select("doc_id", "text", "lang", "n_chars", "n_lines", "n_dropped").orderBy("doc_id").collect()] == [(1, SHARED[0], "en", len(SHARED[0]), 1, 0), (2, "more", "fr", 4, 2, 1)]
    same = drop_shared_lines(df, counts=False)
    assert same.schema.names == df.schema.names and same.orderBy("doc_id").collect()[1].n_lines == 7
    assert drop_shared_lines(df.where("false")).count() == 0


def passage_rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (50, 51, 49, 80, 140)]
    rows = []
    for i in range(50):
        own = [rng.choice(words) for _ in range(rng.randrange(0, 160))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(own) + 1)
            own[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(own)))
    return [*rows, (200, None), (201, ""), (None, " ".join(passages[3])), (202, " ".join(passages[0])), (203, " ".join(passages[0])), (203, " ".join(passages[1])), (204, " ".join(["a"] * 3000)), (205, " ".join(["a"] * 120)), (206, " ".join(passages[4] * 30)), (207, "solo " + " ".join(passages[2]))]


@pytest.mark.parametrize("window", [50, 20, 3])
def test_passages_like_brute_force(spark, window):
    rows = passage_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(drop_repeated_passages(df, window=window), ("n_words", "n_removed")) == brute_passages(rows, window)


def test_passages_keep_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 1, "a"), (2, text + " more", 1, "b"), (None, text, 1, "c")], "doc_id int, text string, n_chars long, rest string")
    out = drop_repeated_passages(df)
    assert out.columns == ["doc_id", "text", "n_chars", "rest", "n_words", "n_removed"]
    assert sorted((r.rest, r.n_chars, r.n_words, r.n_removed) for r in out.collect()) == [("a", len(text), 60, 0), ("b", 4, 61, 60), ("c", len(text), 60, 0)]
    assert drop_repeated_passages(df.where("false")).count() == 0


def test_lines_with_clashing_names(spark):
    names = ["doc_id", "text", "doc", "__doc", "__shared_lines", "drops", "dropped_from", "rest", "body", "a.b", "h1", "we`ird", "least"]
    rows = [(1, SHARED[0], *range(11)), (2, SHARED[0] + "\nmore", *range(11)), (None, None, *[None] * 11)]
    out = drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` long" for n in names[2:])))
    assert out.columns == [*names, "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, SHARED[0], *range(11), 1, 0), (2, "more", *range(11), 2, 1), (None, "", *[None] * 11, 1, 0)], key=str)


def test_long_blanks_are_stripped_in_linear_time():
    import time

    import pyarrow as pa

    from tallyloom.llm.line_dedup import _lines

    blank = " " * 2_000_000
    rows = [blank, blank + "The same line here." + blank, "\t" * 40 + "\n" + " " * 40 + "x" * 12 + " " * 40 + "\n" + " " * 16 + "y" + " " * 16, None, ""]
    began = time.perf_counter()
    starts, ends, first, h1, _, chars = _lines(pa.array(rows))
    assert time.perf_counter() - began < 5
    assert chars.tolist() == [0, 19, 0, 12, 1, 0, 0] and first.tolist() == [0, 1, 2, 5, 6, 7]
    assert h1[1] == _lines(pa.array(["the same line HERE."]))[3][0]


def test_passages_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    names = ["doc", "body", "rest", "__hits", "__copied", "__doc", "a.b", "key", "known", "hash"]
    df = spark.createDataFrame([(1, text, *range(10)), (2, text + " more", *range(10))], "doc_id int, text string, " + ", ".join(f"`{n}` long" for n in names))
    out = drop_repeated_passages(df)
    assert out.columns == [*df.columns, "n_words", "n_removed"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, text, *range(10), 60, 0), (2, "more", *range(10), 61, 60)]
