"""Vectors that point almost the same way: spherical k-means cells, blocked cosine products, one representative a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.columns import named, renamed
from tallyloom.llm.components import components
from tallyloom.llm.groups import Sets, pieces
from tallyloom.llm.scratch import written

#: Vectors that one product takes from each side, and that a cell is meant for; a task holds as many at least.
BLOCK = 2048
#: Bytes of doubles that a task holds of a cell's own vectors at most (if that is more than ``BLOCK`` of them).
HELD_BYTES = 32 << 20
MAX_CELLS, SAMPLE, SAMPLE_BYTES = 4096, 65_536, 64 << 20


def fit_cells(sample: np.ndarray, k: int, *, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """``k`` unit centroids of unit vectors; a cell that empties takes the vector that fits its own worst."""
    rng = np.random.default_rng(seed)
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    k = min(k, len(sample))
    centres = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        own, fit = np.empty(len(sample), np.int64), np.empty(len(sample))
        for lo in range(0, len(sample), 4096):
            s = sample[lo : lo + 4096] @ centres.T
            own[lo : lo + 4096], fit[lo : lo + 4096] = s.argmax(1), s.max(1)
        order = np.argsort(own, kind="stable")
        found, start = np.unique(own[order], return_index=True)
        sums = np.zeros_like(centres)
        sums[found] = np.add.reduceat(sample[order], start)
        empty = np.setdiff1d(np.arange(k), found)
        sums[empty] = sample[np.argsort(fit)[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.where(length > 0, length, 1), centres)
    return centres


def pick_cells(sample: np.ndarray, k: int, reach: float) -> np.ndarray:
    """Centroids for ``k`` cells, or a fourth of them and so on, while vectors then visit about as small a share of the cells.

    A share of s means s times the products of all pairs, however many cells there are; fewer cells mean fewer copies sent.
    """
    found = []
    while True:
        centres = fit_cells(sample, k)
        found.append((_visits(sample[:: max(1, len(sample) // 4096)], centres, reach)[1].mean() if len(sample) else 1.0, centres))
        if k == 1 or not len(sample):
            break
        k = max(1, k // 4)
    least = min(share for share, _ in found)
    return [centres for share, centres in found if share <= 1.25 * least][-1]


def _unit(col: pa.Array, dims: int) -> np.ndarray:
    """The first ``dims`` components, or zeros beyond its own, of each row as a vector of length 1 in doubles."""
    start, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(start)
    out = np.zeros((len(col), dims))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        own = flat[start[rows][:, None] + np.arange(size)].astype(np.float64)
        own /= np.abs(own).max(1, keepdims=True)  # so that squares neither overflow nor vanish
        own /= np.linalg.norm(own, axis=1, keepdims=True)
        out[rows, : min(size, dims)] = own[:, :dims]
    return out


def _visits(unit: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector, and which cells it goes to.

    Let x be at home in a and y in b, |x - y| <= reach. As x.(a - b) >= 0 and y.(b - a) >= 0 add up to
    (x - y).(a - b) <= reach |a - b|, one of the two is at most half of that: a vector that goes to every cell within
    this margin meets, there or at home, all vectors that are so near. No pair is lost. That holds as well if x and y are
    parts of longer vectors, as parts are no farther from each other.
    """
    score = unit @ centres.T
    home = score.argmax(1)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centres @ centres.T)))
    gap = score[np.arange(len(unit)), home][:, None] - score
    return home, gap <= 0.5 * reach * apart[home] + 1e-9


def _compare(cells: int, floor: float):
    """From rows sorted by cell, block and length, the block's own vectors first, to counts and links.

    Which cells a vector was sent to comes with it, as found when it was assigned, so that both sides decide alike which
    of them counts a pair.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, sent = None, [], np.zeros(0, np.int64)
        for part in pieces(batches, ["cell", "block", "dim"], BLOCK):
            cell, block, dim = (part.column(c)[0].as_py() for c in ("cell", "block", "dim"))
            if (cell, block, dim) != key:
                key, held, sent = (cell, block, dim), [], np.zeros(0, np.int64)
            new = [_unit(part.column("embedding"), dim), *(part.column(c).to_numpy() for c in ("v", "weight", "home", "own"))]
            unit, v, weight, home, own = new
            mine = (own == block) & (home == cell)
            old = len(held[0]) if held else 0
            if mine.any():
                held = [np.concatenate([a, b[mine]]) for a, b in zip(held, new, strict=True)] if held else [a[mine] for a in new]
                goes = [np.frombuffer(x, np.uint16).astype(np.int64) + (old + k) * cells for k, x in enumerate(part.column("goes").filter(pa.array(mine)).to_pylist())]
                sent = np.concatenate([sent, *goes])
            if not held:
                continue
            at = np.full(len(unit), np.iinfo(np.int64).max)  # among own vectors the earlier one stands first
            at[mine] = old + np.arange(int(mine.sum()))
            for lo in range(0, len(held[0]), BLOCK):
                link = held[0][lo : lo + BLOCK] @ unit.T >= floor
                link &= (lo + np.arange(len(link)))[:, None] < at[None, :]
                r, c = np.nonzero(link)
                # both at home here: in the lower block only; else in the lower of the two homes if they meet in both
                wanted = (lo + r) * cells + home[c]
                there = sent[np.minimum(np.searchsorted(sent, wanted), len(sent) - 1)] == wanted
                once = np.where(home[c] == cell, own[c] >= block, (cell < home[c]) | ~there)
                r, c = r[once], c[once]
                if not len(r):
                    continue
                ids = np.concatenate([held[1][lo : lo + BLOCK], v])
                width = len(link)
                links = np.bincount(r, weight[c], len(ids)) + np.bincount(c + width, held[2][lo + r], len(ids))
                label = _labels(r, c + width, ids)
                some = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(label[some])], ["v", "links", "least"])

    return scan


def _labels(r: np.ndarray, c: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each place reaches by the links ``r``-``c``."""
    label = ids.copy()
    for _ in range(12):  # most groups are settled by a few rounds over all links
        low = np.minimum(label[r], label[c])
        before = label.copy()
        np.minimum.at(label, r, low)
        np.minimum.at(label, c, low)
        if (label == before).all():
            return label
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    sets = Sets(len(ids))
    for a, b in zip(place[r].tolist(), place[c].tolist(), strict=True):
        sets.join(a, b)
    return ids[order[[sets.find(int(p)) for p in place]]]


def near_vectors(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", floor: float = 0.95, cells: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``table``: ``id_col``, ``n_links``, ``component_id`` and ``kept``.

    Two vectors link when their cosine, in doubles, is ``floor`` or more (which must be above 0) and they have one
    length. ``n_links`` counts the other rows linked directly, ``component_id`` is the least id reachable, the row's own
    included, and ``kept`` marks the row that stands for its component. A vector that is null, empty, zero or holds null
    or non-finite components links with nothing. Rows without an id link with nothing, have a null component and are not
    kept. Rows that share an id are vectors of their own: each has its own links and the component of its own vector; of
    those whose vector's component has their id, each is kept. Other columns are not returned. Empty input: empty output.

    Method: ``cells`` (default: one for 2048 rows, at most 4096, or fewer if these part the vectors as well) unit
    centroids are fitted by spherical k-means on a sample of at most about ``sample`` vectors and ``SAMPLE_BYTES``; every
    vector is then assigned, by its first components if it is longer than most. A vector is also sent to each cell whose
    border is near enough for a partner on the other side, so no link is lost whatever the centroids. Equal vectors are
    compared once, with their number as weight. The vectors at home in a cell are dealt in blocks, one for each task that
    the session has but not above ``HELD_BYTES``, each of which sees all vectors of the cell pass by. So a vector that
    visits a share s of c cells of n vectors is sent s * max(c, n / block) times. Only counts and one link a vector and
    product leave a task, never all pairs. The centroids are all that is broadcast.
    """
    spark = table.sparkSession
    vector = named(vector_col)
    raw = vector.cast("array<double>")
    fine = named(id_col).isNotNull() & F.coalesce(F.size(raw) > 0, F.lit(False)) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(raw, lambda x: x != 0)
    given = table.select(named(id_col).cast("long").alias("v"), vector.alias("embedding"), F.coalesce(fine, F.lit(False)).alias("fine"))
    good = given.where("fine").select("v", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), F.size("embedding").alias("dim"))
    classes = good.groupBy("h1", "h2").agg(F.min_by("embedding", "v").alias("embedding"), F.min("v").alias("v"), F.count("*").alias("weight"), F.max("dim").alias("dim"))
    classes = written(classes.withColumn("number", F.monotonically_increasing_id()), "vectors")
    lengths = classes.groupBy("dim").agg(F.count("*").alias("n"))
    n, dims, longest = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max_by("dim", F.struct("n", -F.col("dim"))), F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    rows = min(sample, SAMPLE_BYTES // (8 * dims) + 1)
    part = min(1.0, rows / max(n, 1))
    drawn = classes.where(F.col("dim") == dims).where((F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30)) < part).orderBy("v", "h1", "h2").select("embedding").toArrow().column(0).combine_chunks()
    drawn = drawn.combine_chunks() if isinstance(drawn, pa.ChunkedArray) else drawn
    reach = float(np.sqrt(max(0.0, 2 - 2 * floor))) * (1 + 1e-12)
    unit = _unit(drawn, dims) if len(drawn) else np.zeros((0, dims))
    centres = fit_cells(unit, cells) if cells else pick_cells(unit, max(1, min(MAX_CELLS, n // BLOCK)), reach)
    if not len(centres):
        centres = np.eye(1, dims)
    k = len(centres)
    held = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                rows = batch.slice(lo, 1024)
                home, goes = _visits(_unit(pa.array(rows.column("embedding").to_pylist(), rows.column("embedding").type), dims), held.value, reach)
                row, cell = np.nonzero(goes)
                at = pa.array(row)
                own = home[row] == cell
                lists = [np.flatnonzero(goes[r]).astype(np.uint16).tobytes() if mine else None for r, mine in zip(row.tolist(), own.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(home[row].astype(np.int64)), pa.array(lists, pa.binary()), *(rows.column(c).take(at) for c in ("v", "weight", "dim", "embedding"))], ["cell", "home", "goes", "v", "weight", "dim", "embedding"])

    kind = table.schema[vector_col].dataType.simpleString()
    sent = classes.select(F.col("number").alias("v"), "weight", F.col("dim").cast("long").alias("dim"), "embedding").mapInArrow(assign, f"cell long, home long, goes binary, v long, weight long, dim long, embedding {kind}")
    sent = written(sent, "cells")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = max(BLOCK, min(HELD_BYTES // (8 * longest), n // max(tasks, 1)))
    blocks = sent.where("home = cell").groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("nb"))
    dealt = (
        sent.join(F.broadcast(blocks), "cell")  # one row a cell, 4096 at most
        .withColumn("own", F.when(F.col("home") == F.col("cell"), F.pmod(F.xxhash64("v"), F.col("nb"))).otherwise(F.lit(-1).cast("long")))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        .select("cell", "block", "own", "home", F.when(F.col("own") == F.col("block"), F.col("goes")).alias("goes"), "v", "weight", "dim", "embedding")
        .repartition("cell", "block", "dim")
        .sortWithinPartitions("cell", "block", "dim", (F.col("own") != F.col("block")))
    )
    compare = _compare(k, floor)

    found = written(dealt.mapInArrow(compare, "v long, links long, least long"), "near")
    counts = found.groupBy("v").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("v").alias("a"), F.col("least").alias("b")))
    whole = (
        classes.select("h1", "h2", "v", "weight", "number")
        .join(counts.withColumnRenamed("v", "number"), "number", "left")
        .join(joined.withColumnRenamed("node", "number"), "number", "left")
        .select("h1", "h2", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "number").alias("component"))
    )
    ids = whole.groupBy("component").agg(F.min("v").alias("component_id"))
    whole = whole.join(ids, "component").select("h1", "h2", "n_links", "component_id")
    linked = good.select("v", "h1", "h2").join(whole, ["h1", "h2"]).select("v", "n_links", "component_id")
    alone = given.where("not fine").select("v", F.lit(0).cast("long").alias("n_links"), F.col("v").alias("component_id"))
    out = linked.unionByName(alone)
    return renamed(out.select("v", "n_links", "component_id", F.coalesce(F.col("v") == F.col("component_id"), F.lit(False)).alias("kept")), "v", id_col)
