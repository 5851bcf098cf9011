"""Centroid clustering in exact integers: balls of vectors are given to one centroid whole where the triangle inequality allows it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm.columns import named, unused
from tallyloom.llm.scratch import written

#: Vectors of one tree, and of a leaf at most.
TREE, LEAF = 8192, 32
#: Components must be smaller than this, so that all squared distances of up to 2^8 components fit 63 bits.
BOUND = 1 << 26
#: Components of all centroids together, which go to every task and, as sums, to the driver.
MODEL = 1 << 22
#: Rows of exact distances that are made at once.
ROWS = 16_384


class Tree(NamedTuple):
    """Balls over rows in tree order: ball 0 holds all, the halves of ball i are ``down[i]`` and ``down[i] + 1`` (-1: a leaf)."""

    points: np.ndarray
    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    down: np.ndarray
    sums: np.ndarray
    radius: np.ndarray


def grow(points: np.ndarray) -> Tree:
    """A ball tree of integer vectors: halves along the line between two far members; each ball knows its integer sum, count and radius."""
    order = np.arange(len(points))
    lo, hi, down, sums, radius = [0], [len(points)], [], [], []
    at = 0
    while at < len(lo):
        own = points[order[lo[at] : hi[at]]]
        total = own.sum(0)
        real = own.astype(np.float64)
        gap = _norms(real - total / len(own))
        sums.append(total)
        radius.append(float(gap.max()) * (1 + 1e-12) + 1e-9 if gap.any() or (own != own[0]).any() else 0.0)
        if len(own) <= LEAF or not radius[-1]:
            down.append(-1)
        else:
            far = real[gap.argmax()]
            other = real[_norms(real - far).argmax()]
            side = (real - far) @ (other - far)
            middle = len(own) // 2
            order[lo[at] : hi[at]] = order[lo[at] : hi[at]][np.argpartition(side, middle)]
            down.append(len(lo))
            lo += [lo[at], lo[at] + middle]
            hi += [lo[at] + middle, hi[at]]
        at += 1
    return Tree(points[order], order, np.array(lo), np.array(hi), np.array(down), np.array(sums).reshape(len(lo), points.shape[1]), np.array(radius))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def nearest(points: np.ndarray, centroids: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """For each row the nearest of its ``allowed`` centroids, exactly; ties: the smaller number."""
    out = np.empty(len(points), np.int64)
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    narrow = 4 * points.shape[1] * top * top < 1 << 53  # all terms are exact in doubles
    for lo in range(0, len(points), ROWS):
        own, may = points[lo : lo + ROWS], allowed[lo : lo + ROWS]
        if narrow:
            real, c = own.astype(np.float64), centroids.astype(np.float64)
            far = (c * c).sum(1)[None, :] - 2 * (real @ c.T)
            far[~may] = np.inf
            out[lo : lo + ROWS] = far.argmin(1)
            continue
        far = np.full(may.shape, np.iinfo(np.int64).max)
        for j in range(len(centroids)):
            some = may[:, j]
            far[some, j] = ((own[some] - centroids[j]) ** 2).sum(1)
        out[lo : lo + ROWS] = far.argmin(1)
    return out


def settle(tree: Tree, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Balls given whole, as (ball, centroid), and the rows that were looked at one by one, with their centroids.

    A centroid is out for a ball when even the ball's nearest point to it is farther than the ball's farthest point from
    another; the margin covers the rounding of doubles, so what is out is farther for every member. What is left goes down
    with the halves; leaves, and balls of one point repeated, are decided by exact distances.
    """
    k = len(centroids)
    real = centroids.astype(np.float64)
    first = np.array([(centroids[:j] == centroids[j]).all(1).any() if j else False for j in range(k)])  # repeats of an earlier one never win
    balls, may = np.array([0]), np.tile(~first, (1, 1))
    whole: list[tuple[int, int]] = []
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(balls):
        centre = tree.sums[balls] / (tree.hi - tree.lo)[balls][:, None]
        gap = np.sqrt(np.maximum(0.0, (centre * centre).sum(1)[:, None] + (real * real).sum(1)[None, :] - 2 * (centre @ real.T)))
        size = (np.abs(centre).max() + np.abs(real).max()) * np.sqrt(centre.shape[1]) + 1
        slack = 1e-6 * size  # sqrt of a difference of squares loses half the digits
        gap[~may] = np.inf
        radius = tree.radius[balls][:, None]
        may = may & (gap - radius <= gap.min(1, keepdims=True) + radius + slack)
        one = may.sum(1) == 1
        whole += zip(balls[one].tolist(), may[one].argmax(1).tolist(), strict=True)
        same = ~one & (tree.radius[balls] == 0)
        if same.any():
            whole += zip(balls[same].tolist(), nearest(tree.points[tree.lo[balls[same]]], centroids, may[same]).tolist(), strict=True)
        open_ = ~one & ~same
        leaf = open_ & (tree.down[balls] < 0)
        leaves.append((balls[leaf], may[leaf]))
        inner = open_ & (tree.down[balls] >= 0)
        below = tree.down[balls[inner]]
        balls, may = np.concatenate([below, below + 1]), np.concatenate([may[inner]] * 2)
    if not leaves:
        return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends, may = np.concatenate([b for b, _ in leaves]), np.concatenate([m for _, m in leaves])
    count = (tree.hi - tree.lo)[ends]
    rows = np.repeat(tree.lo[ends] - np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count) + np.arange(count.sum()) if len(ends) else np.zeros(0, np.int64)
    return whole, rows, nearest(tree.points[rows], centroids, np.repeat(may, count, axis=0))


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<i8").tobytes()


def _plant(dims: int):
    """Trees of a task's own vectors, a row a tree."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids, points = rows.column("v"), rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            tree = grow(points)
            spans = np.stack([tree.lo, tree.hi, tree.down])
            row = [ids.take(pa.array(tree.order)).to_pylist(), tree.points.astype("<i4").tobytes(), _packed(spans), _packed(tree.sums), tree.radius.astype("<f8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, [pa.list_(pa.int64()), *[pa.binary()] * 4], strict=True)], ["ids", "points", "spans", "sums", "radius"])

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                have = sum(b.num_rows for b in held)
                n = min(batch.num_rows - lo, TREE - have)
                held.append(batch.slice(lo, n))
                lo += n
                if have + n == TREE:
                    yield close()
                    held = []
        if held:
            yield close()

    return plant


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            points, spans, sums, radius = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("points", "<i4"), ("spans", "<i8"), ("sums", "<i8"), ("radius", "<f8")))
            lo, hi, down = spans.reshape(3, -1)
            yield batch.column("ids")[i].values, Tree(points.reshape(-1, dims).astype(np.int64), np.arange(len(points) // dims), lo, hi, down, sums.reshape(-1, dims), radius)


def _sum_up(centroids, dims: int):
    """Each task's sums and counts by centroid, one row a component."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        k = len(c)
        totals, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, tree in _trees(batches, dims):
            whole, rows, own = settle(tree, c)
            for ball, j in whole:
                totals[j] += tree.sums[ball]
                n[j] += tree.hi[ball] - tree.lo[ball]
            n += np.bincount(own, minlength=k)
            for j in np.unique(own).tolist():
                totals[j] += tree.points[rows[own == j]].sum(0)
        some = np.flatnonzero(n)
        columns = [np.repeat(some, dims), np.tile(np.arange(dims), len(some)), totals[some].ravel(), np.repeat(n[some], dims)]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["cluster", "place", "total", "n"])

    return sum_up


def _tell(centroids, dims: int):
    """Each vector's centroid and squared distance."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for ids, tree in _trees(batches, dims):
            whole, rows, own = settle(tree, c)
            cluster = np.empty(len(tree.points), np.int64)
            cluster[rows] = own
            for ball, j in whole:
                cluster[tree.lo[ball] : tree.hi[ball]] = j
            gap = tree.points - c[cluster]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(np.einsum("ij,ij->i", gap, gap))], ["v", "cluster", "distance"])

    return tell


def whole_vectors(table: DataFrame, *, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``(v, x)``: ids and integer components floor(scale * component) of the vectors of ``dims`` finite components."""
    given = table.select(named(id_col).cast("long").alias("v"), named(vector_col).cast("array<double>").alias("raw"))
    fine = (F.size("raw") == dims) & F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fits = F.forall("raw", lambda x: F.abs(x * scale) < BOUND)
    x = F.when(fits, F.transform("raw", lambda x: F.floor(x * scale).cast("long"))).otherwise(F.raise_error(F.lit(f"a component is {BOUND} or more after scaling")))
    return given.where(F.coalesce(fine, F.lit(False))).select("v", x.alias("x"))


def fit_centroids(trees: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """``rounds`` of assignment and exact floor means; a centroid without vectors stays."""
    sc, dims = trees.sparkSession.sparkContext, centroids.shape[1]
    for _ in range(rounds):
        held = sc.broadcast(centroids)
        parts = trees.mapInArrow(_sum_up(held, dims), "cluster long, place long, total long, n long")
        sums = parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()  # no more than the model
        held.destroy()
        centroids = centroids.copy()
        at = [sums.column(c).to_numpy() for c in ("cluster", "place")]
        centroids[at[0], at[1]] = sums.column("total").to_numpy() // np.maximum(1, sums.column("n").to_numpy())
    return centroids


def seeds(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors with the ``k`` smallest SHA-256 of ``seed`` and id, in that order; equal ids by their components, null ids last."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("v").cast("string")), 256)
    first = vectors.orderBy(digest.asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r.x for r in first], np.int64)


def cluster_vectors(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2:") -> DataFrame:
    """Per vector: ``id_col``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid`` (its components).

    Vectors of other lengths than ``dims``, null ones and ones with null or non-finite components are left out. Components
    become floor(``scale`` * component). Centroids start as the ``k`` vectors with the smallest SHA-256 of ``seed`` and id
    (fewer vectors: all of them); ``rounds`` times every vector goes to the nearest (ties: the smaller number) and centroids
    become exact floor means, empty ones stay; then vectors are assigned once more. All distances and sums are integers. Rows
    that share an id are vectors of their own; rows without an id come last as seeds and are assigned like others. Other
    columns are not returned. Empty input: empty output. A component of ``BOUND`` or more after scaling raises an error, as
    distances would not fit 63 bits.

    Plan: tasks turn their own vectors into ball trees once, ``TREE`` vectors a row, and write them; no vector is shuffled.
    A round is one pass over the trees with the centroids broadcast (``MODEL`` components at most); a task returns a row a
    centroid and component, which are summed map-side again, and what reaches the driver is the size of the centroids.
    Vectors that repeat, however often, are balls of radius zero.
    """
    if k * dims > MODEL or dims > 256:
        raise ValueError("the centroids are too many, or too long")
    spark = table.sparkSession
    vectors = whole_vectors(table, id_col=id_col, vector_col=vector_col, dims=dims, scale=scale)
    name = unused(table.select(named(id_col)), "cluster")
    columns = f"v long, {name} int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    centroids = seeds(vectors, k, seed)
    if not len(centroids):
        return _named_out(spark.createDataFrame([], columns), id_col)
    trees = written(vectors.mapInArrow(_plant(dims), "ids array<long>, points binary, spans binary, sums binary, radius binary"), "trees")
    centroids = fit_centroids(trees, centroids, rounds)
    held = spark.sparkContext.broadcast(centroids)
    told = written(trees.mapInArrow(_tell(held, dims), "v long, cluster int, distance long"), "clusters")
    held.destroy()
    totals = {r.cluster: r.total for r in told.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows at most
    model = _model(spark, centroids, totals)
    return _named_out(told.join(F.broadcast(model), "cluster").select("v", F.col("cluster").alias(name), "distance", "cluster_inertia", "inertia", "centroid"), id_col)


def _model(spark: SparkSession, centroids: np.ndarray, totals: dict[int, int]) -> DataFrame:
    rows = [(j, totals[j], sum(totals.values()), centroids[j].tolist()) for j in sorted(totals)]
    return spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")


def _named_out(out: DataFrame, id_col: str) -> DataFrame:
    return out.select(*[F.col(c).alias(id_col if c == "v" else c) for c in out.columns])
