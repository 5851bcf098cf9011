import numpy as np
import pytest

from tallyloom.llm import embedding_dedup as e


def brute(rows, floor):
    unit, size = {}, {}
    for k, (i, v) in enumerate(rows):
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        a = np.array(v, float)
        unit[k], size[k] = a / np.linalg.norm(a), len(v)
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = dict.fromkeys(range(len(rows)), 0)
    for a in unit:
        for b in unit:
            if a < b and size[a] == size[b] and unit[a] @ unit[b] >= floor:
                links[a] += 1
                links[b] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                up[max(x, y)] = min(x, y)
    return sorted(((i, links[k], None if i is None else find(i), i is not None and find(i) == i) for k, (i, _) in enumerate(rows)), key=str)


def rows(n=260, dims=16, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    hub = rng.normal(size=dims)
    for i in range(n):
        near = rng.random() < 0.5
        base = hub if rng.random() < 0.4 else np.random.default_rng(int(rng.integers(6)) + 50).normal(size=dims)
        v = base + rng.normal(size=dims) * rng.choice([0.02, 0.1, 0.25]) if near else rng.normal(size=dims)
        out.append((i, [float(np.float32(x)) for x in v]))
    same = out[3][1]
    return [*out, (900, same), (901, same), (902, [2 * x for x in same]), (903, None), (904, []), (905, [0.0] * dims), (906, [float("nan")] * dims), (907, [float("inf")] + [1.0] * (dims - 1)), (None, same), (908, same + [0.0]), (909, [1e-30] * dims), (910, [1e30] * dims), (911, [None] + same[1:])]


@pytest.mark.parametrize(("cells", "block"), [(None, 2048), (7, 2048), (7, 20), (1, 16)])
def test_like_brute_force(spark, monkeypatch, cells, block):
    monkeypatch.setattr(e, "BLOCK", block)
    given = rows()
    df = spark.createDataFrame([(i, v, 0) for i, v in given], "vec_id long, embedding array<float>, kept int")
    out = e.near_vectors(df, floor=0.95, cells=cells)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()), key=str) == brute(given, 0.95)


def test_empty_and_hopeless_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert e.near_vectors(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in e.near_vectors(spark.createDataFrame([(4, None)], schema)).collect()] == [(4, 0, 4, True)]


def test_cells_are_unit_vectors():
    sample = np.random.default_rng(0).normal(size=(300, 8))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    centres = e.fit_cells(sample, 12)
    assert centres.shape == (12, 8) and np.allclose(np.linalg.norm(centres, axis=1), 1)
    assert (sample @ centres.T).max(1).mean() > (sample @ sample[:12].T).max(1).mean() - 0.2


def test_vectors_of_other_lengths(spark, monkeypatch):
    """Cells are of the commonest length; a longer vector is assigned by its first components."""
    monkeypatch.setattr(e, "BLOCK", 16)
    rng = np.random.default_rng(4)
    given = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(80)]
    for n in (3, 30):
        base = rng.normal(size=n)
        given += [(1000 * n + k, [float(x) for x in base + rng.normal(size=n) * 0.02]) for k in range(12)]
    given += [(5000, [0.0] * 10 + [1.0] * 20), (5001, [0.0] * 10 + [1.0] * 20)]
    df = spark.createDataFrame(given, "`vec.id` long, `a.b` array<double>")
    out = e.near_vectors(df, id_col="vec.id", vector_col="a.b")
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(given, 0.95)


def test_fewer_cells_where_more_part_nothing():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=(4000, 64))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    groups = np.repeat(rng.normal(size=(40, 64)), 100, axis=0) + rng.normal(size=(4000, 64)) * 0.05
    groups /= np.linalg.norm(groups, axis=1, keepdims=True)
    few, many = (len(e.pick_cells(x, 64, 0.31)) for x in (noise, groups))
    assert few <= many and many >= 16


def test_rows_that_share_an_id(spark, tmp_path):
    from tallyloom.llm import registry

    rows = [(1, [1.0, 0.0]), (2, [1.0, 1e-9]), (2, [0.0, 1.0]), (2, [1.0, 0.0]), (0, [0.0, -1.0]), (7, [0.0, -1.0]), (7, None), (None, [1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.op2_embedding_dedup(spark, str(tmp_path)).collect()
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (2, 0, 2, True), (0, 1, 0, True), (7, 1, 0, False), (7, 0, 7, True), (None, 0, None, False)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
