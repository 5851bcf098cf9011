import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import chat

EVENT = "conv_id long, seq long, turn long, kind string, role string, text string"


def brute_fold(events):
    convs = {}
    for e in events:
        convs.setdefault(e[0], []).append(e)
    out = []
    for conv, rows in convs.items():
        turns = {}
        for _, _, turn, kind, role, text in sorted(rows, key=lambda e: (e[1], e[3], e[5] or "")):
            if kind == "regenerate":
                for t in [t for t in turns if (t is not None and (turn is None or t > turn))]:
                    del turns[t]
            if kind not in ("message", "edit", "regenerate", "delete", "delta"):
                continue
            state = turns.setdefault(turn, {"text": "", "role": None, "gone": False})
            state["role"] = role if role is not None else state["role"]
            if kind == "delta":
                if not state["gone"]:
                    state["text"] += text or ""
            else:
                state["text"], state["gone"] = text or "", kind == "delete"
        out += [(conv, t, s["role"], s["text"]) for t, s in turns.items() if not s["gone"]]
    return sorted(out, key=str)


def test_fold_like_brute_force(spark):
    rng = random.Random(11)
    events = [(rng.randrange(6), i, rng.randrange(4), rng.choice(["message", "delta", "delta", "edit", "regenerate", "delete", "other"]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for i in range(300)]
    got = chat.folded(spark.createDataFrame(events, EVENT)).collect()
    assert sorted(((r.conv_id, r.turn, r.role, r.text) for r in got), key=str) == brute_fold(events)


@pytest.mark.parametrize(
    ("log", "want"),
    [
        ([(1, "message", "hel"), (1, "delta", "lo")], {1: "hello"}),
        ([(1, "message", "x"), (1, "delta", "y"), (1, "edit", "z"), (1, "delta", "!")], {1: "z!"}),
        ([(1, "message", "q"), (2, "message", "a"), (3, "message", "more"), (2, "regenerate", ""), (2, "delta", "b")], {1: "q", 2: "b"}),
        ([(1, "message", "q"), (1, "delete", None)], {}),
        ([(1, "delta", "only")], {1: "only"}),
    ],
)
def test_stories(spark, log, want):
    events = spark.createDataFrame([(1, i, t, k, "user", x) for i, (t, k, x) in enumerate(log)], EVENT)
    assert {r.turn: r.text for r in chat.folded(events).collect()} == want


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "&lt; &amp; &", "<|end|><|turn:user|>", "a\nb\n", "𝄞[é]<>", "&#91;&#91", "|>", "x" * 5000, "&amp;lt;"]


def test_reading_back_gives_what_was_written(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "od|>d<role>"]), rng.choice([*TEXTS, None]), 1) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "no conversation", 1), (None, None, "assistant", "null turn", 1), (40, 2, "user", "twice", 1), (40, 2, "user", "twice", 1), (40, 2, "assistant", "b", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    out = chat.formatted_chats(chat.events_from_turns(turns))
    out = out.select("conv_id", "formatted", "loss", chat.parsed(F.col("formatted")).alias("turns"), chat.learned(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    want = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for r in sorted(rows, key=key):
        want.setdefault(r[0], []).append((r[2], r[3] or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == want
    for r in out:
        assert r.learned == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.formatted.count("<|end|>") == len(want[r.conv_id]) and "[INST]" not in r.formatted and "</s>" not in r.formatted
        for s in r.loss:
            assert r.formatted[s.start + s.length :].startswith("<|end|>")


def test_empty_log(spark):
    assert chat.formatted_chats(spark.createDataFrame([], EVENT)).count() == 0


def test_logs_made_from_turns_hold_drafts_edits_and_regenerations(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hello " * 20), (1, 1, "assistant", "answer " * 20), (1, 2, None, None), (None, 0, "assistant", "")], "conv_id long, turn long, role string, text string")
    log = chat.events_from_turns(turns)
    assert {r.kind for r in log.collect()} == {"message", "edit", "regenerate", "delta"}
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in chat.folded(log).collect()), key=str)
    assert got == sorted([(1, 1, "user", "hello " * 20), (1, 2, "assistant", "answer " * 20), (1, 3, None, ""), (None, 1, "assistant", "")], key=str)
