import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.llm.fill_middle import BOUNDARIES, WORDS, fill_middle, restored, units

TEXTS = ["", " ", "a", "a b", "  a\tb \n", "a\n\nb\n", "😀 b　c  é", "x<P>y z", "<S", "> a <", "\x0b\x0c", "a\u0085b c", "\n" * 5, "tail " * 2000 + " " * 3000]


@pytest.mark.parametrize("grammar", list(BOUNDARIES))
def test_boundaries_say_what_grammars_say(spark, grammar):
    got = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", units(F.col("text"), grammar).alias("u")).collect()
    assert [(r.text, r.u) for r in got] == [(t, re.findall(grammar, t)) for t in TEXTS]


def plain(doc_id, text, rate):
    text = text or ""
    u = re.findall(WORDS, text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, None, text
    if h[3] % 100 < 80:
        return len(u), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate", [50, 100, 0])
def test_forms_like_brute_force(spark, rate):
    rows = [(i * len(TEXTS) + k, t) for i in range(12) for k, t in enumerate(TEXTS)] + [(None, "no id here"), (5, None), (5, "again again"), (-7, "below zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("h", F.lit(1)).withColumn("a.b", F.lit(2))
    got = fill_middle(docs, rate=rate)
    assert got.columns == ["doc_id", "text", "h", "a.b", "n", "form", "prefix", "middle", "suffix", "output"]
    key = lambda r: str(r)
    back = got.select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", "output", restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted((tuple(r)[:-1] for r in back), key=key) == sorted(((i, t, *plain(i, t, rate)) for i, t in rows), key=key)
    assert all(r.back == (r.text or "") for r in back)
    assert {r.form for r in back} == ({"plain"} if not rate else {"plain", "psm", "spm"})


def test_no_python_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle(empty).collect() == []
    plan = fill_middle(empty)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
