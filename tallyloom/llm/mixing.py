"""Sources mixed to target weights: entropy balancing by distributed Newton steps, then rounding to whole copies."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.llm.columns import named, renamed, unused
from tallyloom.llm.scratch import tidy, written

#: Sources up to which tables of one row a source, some 100 bytes each, are broadcast; with more, rows are dealt by source and ``SALTS``.
FEW_SOURCES, SALTS = 100_000, 32

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, *, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``sources`` (one row each: source, source_size) with ``target``.

    Sources in code point order, null last, weigh ``weights``, repeating; together they get ``share`` of all sizes; a
    target stops at ``cap`` times its source's size and what is above goes to the others by weight. In order of size by
    weight, the sources that stop come first, so running sums find the level at once. One row a source is sorted.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    ratio = F.col("source_size") * cap / F.col("weight")
    whole, before = Window.partitionBy(), Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("level", level).withColumn("stops", ratio <= F.col("level"))
    leveled = leveled.withColumn("height", F.min(F.when(~F.col("stops"), F.struct(ratio.alias("ratio"), F.col("level")))).over(whole)["level"])
    return leveled.select("source", "source_size", F.when(F.col("stops"), F.col("source_size") * cap).otherwise(F.col("weight") * F.col("height")).cast("double").alias("target"))


def tilt(sizes: DataFrame, targets: DataFrame, *, cap: float, rounds: int = 60, near: float = 1e-7, many: bool = False) -> DataFrame:
    """``targets`` with ``tilt``: a document of size x in the source has the rate min(cap, exp(tilt * x / mean size)).

    These rates are the nearest to 1 in relative entropy whose tokens add up to the target. ``tilt`` is the dual
    variable of that constraint; the dual is convex, and every round makes one Newton step for all sources at once from
    sums over ``sizes`` (source, size, n: documents of a size count together). A step that leaves the bracket kept so
    far is replaced by its middle. Sources that cannot move (no words, or target at the cap) have a null tilt.
    """
    mean = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"), F.greatest(F.min(F.when(F.col("size") > 0, F.col("size"))), F.lit(1)).alias("least"))
    state = _with(targets, mean, many=many)
    free = (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * cap * (1 - 1e-12))
    state = state.withColumn("tilt", F.when(free, F.lit(0.0))).withColumn("lo", F.lit(-1e5)).withColumn("hi", F.col("mean") / F.col("least") * log(cap)).withColumn("off", F.when(free, F.lit(1.0)))
    state = written(state, "tilt")
    for _ in range(rounds):
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        # every source is in ``sizes``, so its state rides along as keys: one shuffle a round, after a map-side combine
        sums = _with(sizes, state.drop("off"), "inner", many=many).groupBy("source", "source_size", "target", "mean", "tilt", "lo", "hi").agg(
            F.sum(F.col("n") * F.col("size") * F.least(rate, F.lit(cap))).alias("got"),
            F.sum(F.when(rate < cap, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
        )
        free = F.col("tilt").isNotNull()
        over = F.when(free, F.col("got") - F.col("target"))
        state = sums.withColumn("off", F.abs(over) / F.col("target"))
        state = state.withColumn("lo", F.when(over < 0, F.col("tilt")).otherwise(F.col("lo"))).withColumn("hi", F.when(over > 0, F.col("tilt")).otherwise(F.col("hi")))
        step = F.col("tilt") - F.try_divide(over, F.col("slope"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        middle = F.when(F.col("lo") < -1e4, F.least(F.col("hi"), F.lit(0.0)) * 2 - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        moved = F.when(F.col("off") <= near, F.col("tilt")).when(F.coalesce(inside, F.lit(False)), step).otherwise(middle)
        state = written(state.withColumn("tilt", F.when(F.col("tilt").isNotNull(), moved)).drop("got", "slope"), "tilt")
        tidy(state.sparkSession)
        if state.where(F.col("off") > near).isEmpty():
            break
    return state.select("source", "source_size", "target", "mean", "tilt")


def _with(left: DataFrame, right: DataFrame, how: str = "left", *, many: bool = False) -> DataFrame:
    """``left`` with the columns of ``right``, a row a source, null sources included.

    ``right`` is broadcast, its rows having been counted; with ``many`` sources it is sent ``SALTS`` times instead, and
    the rows of ``left`` are dealt by source and salt, so that no source's rows meet in one task.
    """
    other = right.withColumnRenamed("source", "__source")
    keys = (F.coalesce(F.col("source"), F.lit("")) == F.coalesce(F.col("__source"), F.lit(""))) & (F.col("source").isNull() == F.col("__source").isNull())
    if not many:
        return left.join(F.broadcast(other), keys, how).drop("__source")
    salted = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    other = other.withColumn("__salts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(other, keys & (F.col("__salt") == F.col("__salts")), how).drop("__source", "__salt", "__salts")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (id, source, size, row) with ``nth``, from 0, among the rows that agree in id, source and size.

    Which of these gets which number makes no difference to what is mixed. However many they are, a window holds those
    of one task of the scan only; what the tasks before had is added.
    """
    rows = rows.withColumns({"like": F.xxhash64("id", "source", "size"), "unit": F.shiftright("row", 33)})
    within = F.row_number().over(Window.partitionBy("like", "unit").orderBy("row")) - 1
    many = rows.groupBy("like").agg(F.min("unit").alias("a"), F.max("unit").alias("z")).where("a < z").select("like")
    counts = rows.join(many, "like", "left_semi").groupBy("like", "unit").agg(F.count("*").alias("n"))
    before = counts.select("like", "unit", F.coalesce(F.sum("n").over(Window.partitionBy("like").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.withColumn("within", within).join(before, ["like", "unit"], "left").select("id", "source", "size", "row", (F.col("within") + F.coalesce("before", F.lit(0))).alias("nth"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, sections: int = 1024) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``size``, ``source``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``size`` is the number of words (runs without ASCII white space; null text: 0); ``taken`` is ``size`` times
    ``copies``, which is at most ``cap``. Targets are those of ``source_targets``, rates those of ``tilt``. Rates are
    rounded by a fraction of each row and one shift a source: the copies are the whole part of rate + fraction + shift.
    More shift never means fewer copies, so the shift at which the source's words come nearest to its target is found by
    cutting its range into ``sections`` again and again. What is left is at most half the size of the one document at
    which the sum steps over the target; the documents up to the size of what is left are then rounded anew in the same
    way, and up to three more a source, each taken once more or once less, bring it nearer. Reruns agree.

    The fraction follows from id, source and size, and for rows that share these from their number among them, so rows
    of one id, or without an id, spread over all fractions. Null sources are a source of their own, the last. Empty
    texts are taken as their rate rounds and count no words. Empty input: empty output. Columns of any names are taken.
    """
    rows = _rows(docs, id_col=id_col, text_col=text_col, source_col=source_col, row=F.monotonically_increasing_id())
    out = _copies(rows, weights=weights, share=share, cap=cap, sections=sections)
    return renamed(out.select("id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")), "id", id_col)


def _rows(docs: DataFrame, *, id_col: str, text_col: str, source_col: str, row: Column) -> DataFrame:
    words = F.coalesce(F.regexp_count(named(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return written(docs.select(named(id_col).alias("id"), named(source_col).cast("string").alias("source"), words.alias("size"), row.alias("row")), "sizes")


def _copies(rows: DataFrame, *, weights: tuple[float, ...], share: float, cap: int, sections: int = 1024) -> DataFrame:
    """``rows`` (id, source, size, row) with ``source_size``, ``target`` and ``copies``."""
    spread = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    golden = 0.6180339887498949  # multiples of it fill the circle evenly
    rows = written(_numbered(rows).withColumn("fraction", F.pmod(spread + F.col("nth") * golden, F.lit(1.0))).drop("nth"), "rows")
    sizes = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    sources = written(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    many = sources.count() > FEW_SOURCES
    targets = source_targets(sources, weights=weights, share=share, cap=cap)
    state = written(tilt(sizes, written(targets, "targets"), cap=cap, many=many), "state")

    free = F.col("tilt").isNotNull()
    rate = F.when(free, F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(cap)))).when(F.col("source_size") > 0, F.lit(float(cap))).otherwise(F.lit(1.0))
    # copy c of a row is taken from shift c - rate - fraction on
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.lit(cap)), lambda c: c - F.col("rate") - F.col("fraction")))
    rated = _with(rows, state, many=many).withColumn("rate", rate)
    moving = rated.where(free & (F.col("size") > 0))
    left = written(moving.select("source", "size", steps.alias("at")), "steps")
    goals = state.where(free).select("source", "target")
    shift = _nearest_shift(left, goals, cap=cap, sections=sections, many=many)
    # A large document at the step can leave much open: the smaller ones are then rounded anew to what the others leave.
    done = _with(left, shift, "inner", many=many).where("at < shift")
    off = _with(goals, done.groupBy("source").agg(F.sum("size").alias("got")), many=many).select("source", F.abs(F.col("target") - F.coalesce("got", F.lit(0))).alias("open"))
    fixed = _with(done, off, "inner", many=many).where("size > open").groupBy("source").agg(F.sum("size").alias("fixed"))
    rest = _with(goals, fixed, many=many).select("source", (F.col("target") - F.coalesce("fixed", F.lit(0))).alias("target"))
    off = written(off, "open")
    small = written(_with(left, off, "inner", many=many).where("size <= open").select("source", "size", "at"), "small")
    again = _nearest_shift(small, written(rest, "rest"), cap=cap, sections=sections, many=many).withColumnRenamed("shift", "again")
    out = _with(_with(rated, shift, many=many), _with(off, again, many=many), many=many).withColumn("shift", F.when(F.col("size") <= F.col("open"), F.col("again")).otherwise(F.col("shift")))
    taken = F.when(free & (F.col("size") > 0), F.size(F.filter(F.sequence(F.lit(1), F.lit(cap)), lambda c: (c - F.col("rate") - F.col("fraction")) < F.col("shift")))).otherwise(F.floor(F.col("rate") + F.col("fraction") * F.when(F.col("rate") < cap, F.lit(1.0)).otherwise(F.lit(0.0))))
    copies = F.least(taken.cast("int"), F.lit(cap))
    rounded = written(out.withColumn("copies", copies).select("id", "row", "size", "source", "source_size", "target", "copies"), "copies")
    moves = _last_moves(rounded, cap=cap, many=many)  # three a source at most
    if not many:
        moves = F.broadcast(moves)
    return rounded.join(moves, rounded["row"] == moves["__row"], "left").withColumn("copies", F.col("copies") + F.coalesce("__by", F.lit(0))).drop("__row", "__by")


def _nearest_shift(steps: DataFrame, goals: DataFrame, *, cap: int, sections: int, many: bool) -> DataFrame:
    """For each source the ``shift`` at which the sizes of all ``steps`` (source, size, at) below it come nearest to its target.

    A pass sums sizes by section of the range still open, with a map-side combine; one row a source and section is sorted.
    """
    low, high = -2.0 - cap, 1.0 + cap
    found = written(goals.select("source", "target", F.lit(low).alias("lo"), F.lit(high).alias("hi"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("inside")), "shift")
    for _ in range(12):
        section = F.floor((F.col("at") - F.col("lo")) / (F.col("hi") - F.col("lo")) * sections).cast("int")
        # a source's state rides along as keys
        within = _with(steps, found.select("source", "target", "lo", "hi", "base"), "inner", many=many).where("at >= lo and at < hi").withColumn("bin", F.least(section, F.lit(sections - 1)))
        sums = within.groupBy("source", "target", "base", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        total = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        cross = sums.withColumn("total", total).where("total >= target").groupBy("source").agg(F.min_by(F.struct("bin", "total", "words", "n"), "bin").alias("c"))
        width = (F.col("hi") - F.col("lo")) / sections
        none = F.col("c").isNull()
        nxt = _with(found, cross, many=many).select(
            "source",
            "target",
            F.when(none, F.col("lo")).otherwise(F.col("lo") + width * F.col("c.bin")).alias("lo"),
            F.when(none | (F.col("c.bin") == sections - 1), F.col("hi")).otherwise(F.col("lo") + width * (F.col("c.bin") + 1)).alias("hi"),
            F.when(none, F.col("base")).otherwise(F.col("c.total") - F.col("c.words")).alias("base"),
            F.when(none, F.lit(0)).otherwise(F.col("c.n")).alias("inside"),
        )
        found = written(nxt, "shift")
        tidy(found.sparkSession)
        if found.where("inside > 1").isEmpty():
            break
    # the steps left within [lo, hi) are taken if that comes nearer to the target
    last = _with(steps, found.select("source", "lo", "hi"), "inner", many=many).where("at >= lo and at < hi").groupBy("source").agg(F.sum("size").alias("words"))
    nearer = F.coalesce(F.abs(F.col("base") + F.col("words") - F.col("target")) < F.abs(F.col("base") - F.col("target")), F.lit(False))
    return written(_with(found, last, many=many).select("source", F.when(nearer, F.col("hi")).otherwise(F.col("lo")).alias("shift")), "shift")


def _last_moves(rounded: DataFrame, *, cap: int, many: bool, rounds: int = 3) -> DataFrame:
    """Rows to take once more or once less (``__row``, ``__by``), one a source and round, which close what rounding left open.

    In each round, of the rows not moved yet, the one whose size comes nearest to what a source lacks or has too much.
    """
    off = rounded.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("off"))
    off = written(off, "off")
    moves = None
    for _ in range(rounds):
        left = _with(rounded.where("size > 0"), off, "inner", many=many)
        if moves is not None:
            used = moves.select(F.col("__row").alias("row"))
            left = left.join(used if many else F.broadcast(used), "row", "left_anti")
        way = F.when(F.col("off") > 0, 1).otherwise(-1)
        after = F.abs(F.abs("off") - F.col("size"))
        fit = (((F.col("off") > 0) & (F.col("copies") < cap)) | ((F.col("off") < 0) & (F.col("copies") > 0))) & (after < F.abs("off"))
        best = left.groupBy("source", "off").agg(F.min_by(F.struct("row", way.alias("by"), "size"), F.when(fit, F.struct(after.alias("after"), F.col("id").cast("string").alias("id"), "row"))).alias("m"))
        # what is left open goes along, so a round is one table; sources whose rows are all moved need no more
        best = written(best.select("source", (F.col("off") - F.coalesce(F.col("m.by") * F.col("m.size"), F.lit(0))).alias("off"), "m"), "best")
        off = best.select("source", "off")
        found = best.where("m is not null").select(F.col("m.row").alias("__row"), F.col("m.by").alias("__by"))
        moves = found if moves is None else moves.unionByName(found)
        tidy(moves.sparkSession)
    return moves


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """``docs`` with every row as often as ``mixed`` takes it, row by row, whatever ids rows share or lack.

    ``docs`` is written once with a number for each row. Columns of any names pass through. Empty input: empty output.
    """
    row = unused(docs, "row")
    base = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = _rows(base, id_col=id_col, text_col=text_col, source_col=source_col, row=F.col(row))
    often = _copies(rows, weights=weights, share=share, cap=cap).where("copies > 0").select(F.col("row").alias(row), F.sequence(F.lit(1), F.col("copies")).alias(unused(base, "copies")))
    joined = base.join(often, row)
    return joined.select(*[named(n) for n in docs.columns], F.explode(F.col(often.columns[1])).alias(unused(base, "copy"))).select(*[named(n) for n in docs.columns])
