"""Fill-in-the-middle: texts cut into units at zero-width boundaries, two cuts a text, and the parts put in another order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.columns import named, unused

_SPACE, _SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: A unit's grammar and the boundary that says the same: a unit begins where the class before and the class after differ so.
BOUNDARIES = {
    r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+": f"(?<={_SOLID})(?={_SPACE})",  # words with the space before them
    r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+": f"(?<={_SPACE})(?={_SOLID})",  # words with the space after them
    r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+": f"(?<={_SOLID})(?={_SPACE})|(?<={_SPACE})(?={_SOLID})",  # words and spaces
    r"[^\n]*\n|[^\n]+": r"(?<=\n)(?=[\s\S])",  # lines with their ends
    r"[\s\S]": "",  # code points
}
WORDS = next(iter(BOUNDARIES))
MARKS = ("<P>", "<S>", "<M>")


def units(text: Column, grammar: str = WORDS) -> Column:
    """The units of ``text`` by one of the grammars of ``BOUNDARIES``; joined they are the text. Empty text: none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, BOUNDARIES[grammar], -1))


def _draws(id_: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark`` in ``text``."""
    return F.substring(text, F.locate(mark, text) + F.lit(len(mark)), F.char_length(text))


def _until(text: Column, mark: str) -> Column:
    """What stands before the first ``mark`` in ``text``."""
    return F.substring(text, F.lit(1), F.locate(mark, text) - F.lit(1))


def fill_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grammar: str = WORDS, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """``docs`` with ``n``, ``form``, ``prefix``, ``middle``, ``suffix`` and ``output`` (columns of these names are replaced).

    A text of n units is cut after the smaller and the larger of two draws from 0 to n. ``rate`` of a hundred texts are
    changed, ``spm_rate`` of a hundred of these to ``<S>suffix<P>prefix<M>middle`` ("spm"), the others to
    ``<P>prefix<S>suffix<M>middle`` ("psm"). Texts that are empty or hold one of the marks stay as they are ("plain"), and so
    do all others; their parts are null. The draws follow from ``seed`` and the id alone, so reruns agree.

    Null text: empty. A null id draws as an id of no digits. Rows that share an id draw alike. Very long texts are one row
    as they are in ``docs``. Other columns, of any names, pass through. Empty input: empty output. All is done by built-in
    functions, row by row, without a shuffle.
    """
    made = ["n", "form", "prefix", "middle", "suffix", "output"]
    kept = [c for c in docs.columns if c not in made]
    rest = F.struct(*[named(c).alias(f"c{k}") for k, c in enumerate(kept)])
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    out = docs.select(rest.alias("rest"), text.alias("text"), F.array(*_draws(named(id_col), seed)).alias("h"))
    out = out.withColumn("marked", F.greatest(*[F.contains("text", F.lit(m)) for m in MARKS]))
    changes = (F.col("text") != "") & ~F.col("marked") & (F.col("h")[2] % 100 < rate)
    out = out.withColumn("units", units(F.col("text"), grammar)).withColumn("n", F.size("units").cast("long"))
    out = out.withColumn("form", F.when(~changes, "plain").when(F.col("h")[3] % 100 < spm_rate, "spm").otherwise("psm"))
    cuts = [F.col("h")[i] % (F.col("n") + 1) for i in (0, 1)]
    out = out.withColumn("lo", F.least(*cuts).cast("int")).withColumn("hi", F.greatest(*cuts).cast("int"))
    parts = {"prefix": (F.lit(1), F.col("lo")), "middle": (F.col("lo") + 1, F.col("hi") - F.col("lo")), "suffix": (F.col("hi") + 1, F.size("units") - F.col("hi"))}
    out = out.withColumns({c: F.when(F.col("form") != "plain", F.array_join(F.slice("units", lo, n), "")) for c, (lo, n) in parts.items()})
    p, s, m = (F.lit(x) for x in MARKS)
    said = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("text"))
    out = out.withColumn("output", said)
    return out.select(*[F.col("rest").getField(f"c{k}").alias(c) for k, c in enumerate(kept)], *made)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    p, s, m = MARKS
    psm = F.concat(_until(_after(output, p), s), _after(output, m), _until(_after(output, s), m))
    spm = F.concat(_until(_after(output, p), m), _after(output, m), _until(_after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
