import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import ball_tree
from tallyloom.llm.ball_tree import cluster_vectors, grow, nearest, settle


def plain(points, ids, k, rounds, seed):
    """All distances in Python's integers."""
    order = sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: (hashlib.sha256(f"{seed}{ids[i]}".encode()).hexdigest(), points[i]))
    order += sorted((i for i in range(len(ids)) if ids[i] is None), key=lambda i: points[i])
    centroids = [list(points[i]) for i in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda j: (apart(p, centroids[j]), j)) for p in points]
        if step < rounds:
            for j in set(own):
                mine = [p for p, o in zip(points, own, strict=True) if o == j]
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    far = [apart(p, centroids[o]) for p, o in zip(points, own, strict=True)]
    return [(i, o, d, sum(f for f, q in zip(far, own, strict=True) if q == o), sum(far), centroids[o]) for i, o, d in zip(ids, own, far, strict=True)]


@pytest.mark.parametrize("spread", [3, 1000, 1 << 25])
def test_trees_decide_as_all_distances_do(spread):
    rng = np.random.default_rng(spread)
    base = rng.integers(-spread, spread, (12, 6))
    points = base[rng.integers(0, 12, 3000)] + rng.integers(-2, 3, (3000, 6)) * (rng.random((3000, 1)) < 0.7)
    centroids = np.concatenate([points[rng.choice(3000, 9)], points[:1], points[:1], -points[5:6]])
    tree = grow(points)
    assert (points[tree.order] == tree.points).all() and sorted(tree.order) == list(range(3000))
    for at in range(len(tree.lo)):
        own = tree.points[tree.lo[at] : tree.hi[at]]
        assert (own.sum(0) == tree.sums[at]).all() and np.linalg.norm(own - own.mean(0), axis=1).max() <= tree.radius[at] + 1e-9 * spread
    whole, rows, own = settle(tree, centroids)
    got = np.full(3000, -1)
    got[rows] = own
    for ball, j in whole:
        assert (got[tree.lo[ball] : tree.hi[ball]] == -1).all()
        got[tree.lo[ball] : tree.hi[ball]] = j
    gaps = ((tree.points[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (got == gaps.argmin(1)).all()
    assert len(rows) < 3000  # some balls go whole
    assert (nearest(points, centroids, np.ones((3000, 12), bool)) == ((points[:, None, :] - centroids[None]) ** 2).sum(2).argmin(1)).all()


def test_clusters_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "TREE", 100)
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (7, 4))
    x = base[rng.integers(0, 7, 700)] + rng.normal(0, 0.05, (700, 4))
    x[300:540] = x[300]  # a third are one vector
    ids = [int(i) for i in rng.permutation(690)] + [3, 3, None, None, *range(-6, 0)]
    rows = [(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    odd = [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 2.0, 3.0]), (904, [1.0, float("nan"), 2.0, 3.0]), (905, [float("inf")] * 4), (906, [0.0] * 5)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("a.b", F.lit(1)).repartition(5)
    got = cluster_vectors(table, dims=4, k=11, rounds=3, scale=256, seed="2:")
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    want = plain([[int(np.floor(256 * c)) for c in v] for _, v in rows], ids, 11, 3, "2:")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_few_none_and_too_large(spark):
    few = spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, None)], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, cluster_vectors(few, dims=2, k=40).collect()))
    assert got == [(1, 0, 0, 0, 0, [128, -128]), (2, 0, 0, 0, 0, [128, -128])]
    assert cluster_vectors(few.where("vec_id = 3"), dims=2).collect() == []
    with pytest.raises(Exception, match="after scaling"):
        cluster_vectors(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), dims=2).collect()
