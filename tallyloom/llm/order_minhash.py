"""Document fingerprints by Order MinHash, in DataFrame functions alone.

A k-mer here is ``k`` consecutive words. Each occurrence of a k-mer is an item of its own, (k-mer, number), so repeats
count. Items fall into bins by the high bits of their hash; in each bin the ``pick`` items with the least hash are put
into text order and hashed as one tuple. Tuples therefore change when items move past each other, not only when they
come or go, which makes the share of equal tuples follow edit distance. With ``filled``, a bin with fewer than ``pick``
items takes those that follow in the circle of hashes, so that this holds for short texts too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.llm.columns import named

WHITE = " \t\n\x0b\x0c\r"
#: Low bits of a packed item that hold its place in the text: more places than an array of longs can have.
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1
#: Runs without white space that are no words but text: of 25 characters, or with 3 of a script that is written without spaces.
UNSPACED = r"[^\x20\x09-\x0D]{25}|[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]{3}"


def _fresh(packed: Column, part) -> Column:
    """The places (from 0) at which ``part`` of a sorted array changes."""
    marked = F.transform(packed, lambda x, i: F.when((i == 0) | (part(x) != part(F.get(packed, i - 1))), i).otherwise(F.lit(-1)))
    return F.filter(marked, lambda i: i >= 0)


def _may_be_unspaced(w: Column) -> Column:
    """False for most words, and never for a run like ``UNSPACED``, by lengths alone: the scripts there take 3 bytes a character or more."""
    return (F.octet_length(w) >= 25) | ((F.octet_length(w) >= 9) & (F.octet_length(w) > F.char_length(w)))


def _by_characters(words: str) -> Column:
    """The words of a column of words, with the three-character pieces, one a place, of each run like ``UNSPACED``."""

    def pieces(w: Column) -> Column:
        n = F.char_length(w) - 2
        at = lambda k: F.slice(F.split(w, ""), F.lit(k), n)
        both = lambda a, b: F.concat(a, b)
        return F.when(_may_be_unspaced(w) & w.rlike(UNSPACED), F.zip_with(F.zip_with(at(1), at(2), both), at(3), both)).otherwise(F.array(w))

    return F.when(F.exists(words, _may_be_unspaced), F.flatten(F.transform(words, pieces))).otherwise(F.col(words))


def with_signature(df: DataFrame, text_col: str, out_col: str, *, bits: int = 6, filled: bool = True) -> DataFrame:
    """``df`` with the signature of ``text_col`` (not null): longs, ``bin << 32 | tuple hash``, for the bins that have items.

    k is 2 and so is the number of items a tuple; there are ``2 ** bits`` bins. A text of one word has that word as its
    only item; one without words has an empty signature. Every step is linear in the text but for two sorts of longs.
    Intermediate arrays are columns that the next step reads more than once, so none is computed twice. An item keeps 36 bits
    of its hash beside its place, so of 10^5 different pairs in one text two share an item with likelihood 1/14; what that
    changes is at most the tuples of the bins of these two.

    With ``filled``, as by default, the tuple of each bin is the first two items at or after its start in the circle of hashes: the two
    least in an order that starts there. So all bins have a value, every tuple has two items if the text has, and runs
    without white space count by characters. Bins that hold two items are as without.
    """
    c = F.col
    place_bits = PLACE_BITS
    places = F.lit((1 << place_bits) - 1)
    top = 64 - bits
    out = df.withColumn("__t", F.btrim(c(text_col), F.lit(WHITE)))
    out = out.withColumn("__w", F.when(c("__t") == "", F.array().cast("array<string>")).otherwise(F.split(c("__t"), r"[\x20\x09-\x0D]+"))).drop("__t")
    out = out.withColumn("__w", F.transform(_by_characters("__w") if filled else c("__w"), lambda w: F.xxhash64(w)))
    # word pairs by zipping the hashes with themselves one on; the last word has no partner and goes, unless it is alone
    pairs = F.zip_with(c("__w"), F.slice("__w", F.lit(2), F.greatest(F.size("__w") - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    out = out.withColumn("__g", F.slice(pairs, F.lit(1), F.greatest(F.size("__w") - 1, F.least(F.size("__w"), F.lit(1))))).drop("__w")
    keep = F.lit(~((1 << place_bits) - 1))
    out = out.withColumn("__s", F.sort_array(F.transform("__g", lambda x, i: x.bitwiseAND(keep).bitwiseOR(i.cast("long").bitwiseAND(places))))).drop("__g")
    out = out.withColumn("__r", _fresh(c("__s"), lambda x: F.shiftright(x, place_bits)))
    # runs of one k-mer: number its occurrences, hash (k-mer, number), keep the place
    numbered = F.flatten(F.transform("__r", lambda first, r: F.transform(F.slice("__s", first + 1, F.coalesce(F.get(c("__r"), r + 1), F.size("__s")) - first), lambda x, o: F.xxhash64(F.shiftright(x, place_bits), o).bitwiseAND(keep).bitwiseOR(x.bitwiseAND(places)))))
    out = out.withColumn("__e", F.sort_array(numbered)).drop("__s", "__r")
    out = out.withColumn("__b", _fresh(c("__e"), lambda x: F.shiftrightunsigned(x, top)))

    def value_at(i: Column) -> Column:
        x, y = F.get(c("__e"), i), F.get(c("__e"), F.pmod(i + 1, F.size("__e")) if filled else i + 1)
        place = lambda v: v.bitwiseAND(places)
        item = lambda v: F.shiftright(v, place_bits)
        alone = F.size("__e") == 1 if filled else F.coalesce(F.shiftrightunsigned(x, top) != F.shiftrightunsigned(y, top), F.lit(True))
        value = F.when(alone, F.xxhash64(item(x))).when(place(x) <= place(y), F.xxhash64(item(x), item(y))).otherwise(F.xxhash64(item(y), item(x)))
        return value.bitwiseAND(F.lit(0xFFFFFFFF))

    if not filled:
        return out.withColumn(out_col, F.transform("__b", lambda i: F.shiftleft(F.shiftrightunsigned(F.get(c("__e"), i), top), 32).bitwiseOR(value_at(i)))).drop("__e", "__b")
    # a held bin's value also goes to the empty bins before it, the first one's to those after the last
    most = 1 << bits - 1
    out = out.withColumn("__v", F.transform("__b", lambda i: F.struct(F.shiftright(F.get(c("__e"), i), top).cast("int").alias("bin"), value_at(i).alias("value")))).drop("__e", "__b")
    after = lambda k: F.coalesce(F.get(c("__v"), k)["bin"], F.lit(-most - 1))
    copies = F.flatten(F.transform("__v", lambda v, k: F.array_repeat(v["value"], v["bin"] - after(k - 1))))
    copies = F.concat(copies, F.array_repeat(F.get(c("__v"), F.lit(0))["value"], most - 1 - after(F.size("__v") - 1)))
    signed_bins = F.transform(copies, lambda v, k: F.shiftleft(F.pmod(k + most, F.lit(2 * most)).cast("long"), 32).bitwiseOR(v))
    return out.withColumn(out_col, F.when(F.size("__v") > 0, signed_bins).otherwise(F.array().cast("array<bigint>"))).drop("__v")


def as_text(signature: Column) -> Column:
    """A signature as lower-case hex, ten digits a bin."""
    return F.array_join(F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of bins, of those with items in either, whose tuples agree; 1 if neither has any."""
    bins = lambda s: F.transform(s, lambda v: F.shiftright(v, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _longs(values: list[int]) -> Column:
    """A constant array of longs."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _place_in(value: Column, borders: list[int]) -> Column:
    """How many of the ascending ``borders`` are at most ``value``, by halving."""
    steps, held = [1 << k for k in reversed(range(len(borders).bit_length()))], _longs(borders)
    if not borders:
        return F.lit(0).cast("long")
    inside = lambda at, step: (at + step <= len(borders)) & (F.get(held, at + step - 1) <= value)
    return F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), lambda at, step: at + F.when(inside(at, step), step).otherwise(F.lit(0))).cast("long")


def with_next(df: DataFrame, *, id_col: str, columns: dict[str, str], prepare=lambda df: df, rows_a_bucket: int = 256, max_buckets: int = 1 << 14) -> DataFrame:
    """``df`` with, under the names of ``columns``, values of the row with the next smaller id; after the least comes the greatest.

    Rows are dealt by ranges of the id with about the same number of rows each, whatever the ids, at most ``max_buckets``
    of them; their borders are quantiles of the ids (a scan of this column). The first row of a range is also sent to
    the range above it, as a guest that only answers; borders and first rows, one a range, are all that goes through the
    driver. Rows that share an id follow each other, by their other columns, so these are in one range however many.
    Rows without an id have no next one (nulls). ``prepare`` may add columns to the rows, guests included, before they
    are dealt.
    """
    n = df.agg(F.count(id_col)).first()[0]
    buckets = max(1, min(max_buckets, n // rows_a_bucket))
    borders: list[int] = []
    if buckets > 1:
        shares = [k / buckets for k in range(1, buckets)]
        borders = sorted(set(df.agg(F.percentile_approx(id_col, shares, 10 * buckets)).first()[0]))
    bucket = F.when(F.col(id_col).isNotNull(), _place_in(F.col(id_col), borders))
    found = df.where(F.col(id_col).isNotNull()).select(id_col).groupBy(bucket.alias("b")).agg(F.max(id_col).alias("head"))
    heads = sorted((r.b, r.head) for r in found.collect())
    guests = sorted((int(head), int(heads[(k + 1) % len(heads)][0])) for k, (_, head) in enumerate(heads))
    home = df.withColumns({"__bucket": bucket, "__guest": F.lit(False), "__lane": F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))})
    heads_, goes = _longs([h for h, _ in guests]), _longs([g for _, g in guests])
    at = _place_in(F.col(id_col), [h for h, _ in guests]).cast("int")
    visit = df.where(F.get(heads_, at - 1) == F.col(id_col)) if guests else df.where("false")
    visit = visit.withColumns({"__bucket": F.get(goes, at - 1) if guests else F.lit(0).cast("long"), "__guest": F.lit(True), "__lane": F.lit(0).cast("long")})
    order = Window.partitionBy("__bucket", "__lane").orderBy("__guest", F.col(id_col).desc(), *[F.col(c) for c in dict.fromkeys(columns.values())])
    joined = prepare(home.unionByName(visit)).withColumns({new: F.lead(old).over(order) for new, old in columns.items()})
    return joined.where(~F.col("__guest")).drop("__bucket", "__guest", "__lane")


def fingerprinted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 6, filled: bool = True) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_chars``, ``text``, ``edited``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    ``edited`` is the text whose last floor(n_chars / 2) code points are replaced by the first as many (or all) of the
    next document's, in descending order of ids; after the last comes the first. Null text: empty. Rows without an id
    are edited with nothing and have a ``near_next`` to an empty text. Other columns, of any names, are not returned.
    Empty input: empty output. Texts are shuffled once, by ranges of the id. ``filled`` is as in ``with_signature``.
    """
    base = docs.select(named(id_col).cast("long").alias("doc"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    base = with_next(base, id_col="doc", columns={"next_text": "text", "next_sig": "sig"}, prepare=lambda df: with_signature(df, "text", "sig", bits=bits, filled=filled))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    base = base.withColumn("edited", edited).drop("next_text")
    base = with_signature(base, "edited", "edited_sig", bits=bits, filled=filled)
    return base.select(
        F.col("doc").alias(id_col),
        F.char_length("text").cast("long").alias("n_chars"),
        "text",
        "edited",
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.coalesce("next_sig", F.array().cast("array<bigint>"))).alias("near_next"),
    )
