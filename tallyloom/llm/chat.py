"""Chats rebuilt from an event log and rendered with a loss mask, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Kinds of event that set a turn's text anew; ``delta`` adds to it.
RESETS = ("message", "edit", "regenerate", "delete")

#: What stands for a character inside texts, so that no control string of this or another template is left there.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"))
END = "<|end|>"
#: Characters of a turn's first draft in logs made from turns.
DRAFT = 40


def escaped(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def events_from_turns(turns: DataFrame) -> DataFrame:
    """An event log that says what ``turns`` (conv_id, turn, role, text) says.

    Turns are numbered by (turn, role, text), so rows that share a turn stay apart. The log holds what a chat's history
    would: an assistant's turn is a draft that is streamed, then regenerated and streamed in two deltas; any other is
    a message that begins like the text, then an edit to it. Null text: empty.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()))
    rows = turns.select("conv_id", place.cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    draft, nothing = F.substring("text", 1, DRAFT), F.lit("")
    events = lambda *steps: F.array(*[F.struct((F.col("turn") * 8 + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text")) for k, (kind, text) in enumerate(steps)])
    streamed = events(("message", nothing), ("delta", draft), ("regenerate", nothing), ("delta", F.substring("text", F.lit(1), half)), ("delta", F.substring("text", half + 1, F.char_length("text"))))
    whole = events(("message", draft), ("edit", F.col("text")))
    rows = rows.withColumn("e", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(whole)))
    return rows.select("conv_id", "e.seq", "turn", "e.kind", "role", "e.text")


def folded(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, turn, role, text)`` of an event log ``(conv_id, seq, turn, kind, role, text)``.

    By ``seq``, a ``message`` or ``edit`` sets the turn's text, a ``delta`` adds to it, a ``delete`` takes the turn away
    until it is set again, and a ``regenerate`` sets the turn's text and voids what later turns got before it. The role
    is the last one given. Deltas before any reset count from an empty text. Events with one ``seq`` follow their kind
    and text. Null text: empty; events of a null conversation are one conversation; a null turn is a turn of its own,
    the first; unknown kinds are ignored. Equal events that are stored twice count twice. Empty input: empty output.

    The log is dealt by conversation once; voiding, folding and rendering all use that partitioning.
    """
    earlier = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, -1)
    kept = (
        events.where(F.col("kind").isin("delta", *RESETS))
        .withColumn("turn", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62)).cast("long")))
        .withColumn("void", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier))
        .where("void is null or seq > void")
    )
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")))
    turns = kept.groupBy("conv_id", "turn").agg(log.alias("log"))
    # the place of the last reset, by a fold over the sorted log
    last = F.aggregate("log", F.struct(F.lit(0).alias("i"), F.lit(1).alias("from"), F.lit("").alias("kind"), F.lit(None).cast("string").alias("role")), lambda a, e: F.struct(
        (a["i"] + 1).alias("i"),
        F.when(e["kind"].isin(*RESETS), a["i"] + 1).otherwise(a["from"]).alias("from"),
        F.when(e["kind"].isin(*RESETS), e["kind"]).when(a["kind"] == "delete", F.lit("delete")).otherwise(a["kind"]).alias("kind"),
        F.coalesce(e["role"], a["role"]).alias("role"),
    ))
    turns = turns.withColumn("last", last).where("last.kind <> 'delete'")
    text = F.array_join(F.transform(F.slice("log", F.col("last.from"), F.size("log")), lambda e: e["text"]), "")
    return turns.select("conv_id", "turn", F.col("last.role").alias("role"), text.alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)`` of messages: turns in order, ``loss`` the spans (start, length) of assistant texts.

    A turn is ``<|turn:role|>text<|end|>`` (``<|turn|>`` for a null role), role and text escaped. Starts count code
    points from 0.
    """
    head = F.when(F.col("role").isNull(), F.lit("<|turn|>")).otherwise(F.concat(F.lit("<|turn:"), escaped(F.col("role")), F.lit("|>")))
    parts = messages.select("conv_id", "turn", (F.col("role") == "assistant").alias("learn"), head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"))
    size = F.char_length("head") + F.char_length("body") + len(END)
    before = F.coalesce(F.sum(size).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.when(F.col("learn"), F.struct((before + F.char_length("head")).cast("long").alias("start"), F.char_length("body").cast("long").alias("length")))
    rows = parts.select("conv_id", "turn", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "piece", "span"))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda x: x["span"]), lambda x: x.isNotNull())
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss"))


def parsed(formatted: Column) -> Column:
    """The turns (role, text) that ``rendered`` wrote, as an array."""
    pieces = F.split(formatted, "<[|]end[|]>", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ">", 1)
        role = F.when(head == "<|turn|", F.lit(None).cast("string")).otherwise(unescaped(F.substring(head, F.lit(8), F.char_length(head) - 8)))
        return F.struct(role.alias("role"), unescaped(F.substring(piece, F.char_length(head) + 2, F.char_length(piece))).alias("text"))

    return F.transform(pieces, turn)


def learned(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def formatted_chats(events: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)`` of an event log: fold, then render."""
    return rendered(folded(events))
