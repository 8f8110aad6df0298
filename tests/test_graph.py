import random

from lexatlas.operators.graph import ancestors, components, pairs, rings
from lexatlas.operators.space import knn, svd


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)] + [(None, 4), (5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {(x, find(x)) for x in root}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_pairs_of_groups(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "z")] + [(4, f"x{i}") for i in range(6)], "g int, i string")
    assert {tuple(r) for r in pairs(df, "g", "i", most=5).collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}


def test_rings_count_paths(spark):
    e = spark.createDataFrame([("s", "a", 2), ("s", "b", 1), ("a", "c", 3), ("b", "c", 1), ("a", "b", 9), ("c", "d", 1)], "a string, b string, n long")
    got = {tuple(r) for r in rings(e, spark.createDataFrame([("s",)], "id string"), 3).select("id", "ring", "paths", "weight").collect()}
    assert got == {("s", 0, 0, 0), ("a", 1, 1, 2), ("b", 1, 1, 1), ("c", 2, 2, 4), ("d", 3, 1, 1)}


def test_ancestors_of_a_lattice_with_a_loop(spark):
    o = spark.createDataFrame([("a", ["b", "c"]), ("b", ["d"]), ("c", ["d"]), ("d", []), ("e", None), ("x", ["y"]), ("y", ["x"])], "org_id string, parents array<string>")
    got = {tuple(r) for r in ancestors(o).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x")}


def test_neighbours_in_any_blocks_and_decomposition(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(130, 6)).astype(np.float32)
    x[7] = 0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<float>")
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n > 0, n, 1)
    got = {}
    for r in knn(df, df.repartition(3), 4, block=16).collect():
        got.setdefault(r.id, []).append((r.place, r.other))
    s = np.round((u @ u.T).astype(float), 6)
    np.fill_diagonal(s, -np.inf)
    for i in range(130):
        assert np.allclose(sorted(s[i])[::-1][:4], [s[i, o] for _, o in sorted(got[i])], atol=2e-6)
    values, v, shares = svd(df, 3)
    want = np.linalg.svd(x.astype(float), compute_uv=False)
    assert np.allclose(values, want[:3], atol=1e-4) and np.allclose(v.T @ v, np.eye(3), atol=1e-6) and 0 < shares.sum() <= 1
