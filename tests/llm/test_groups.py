import datetime as dt
import random

import pyarrow as pa

from lexatlas.llm.groups import components

AT = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)


def plainly(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(x, find(x)) for x in root}


def test_random_graphs_paths_and_hubs(spark):
    rng = random.Random(3)
    edges = [(f"p{rng.randrange(300):03}", f"p{rng.randrange(300):03}") for _ in range(170)]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"h{i}") for i in range(80)] + [("x", "x"), (None, "y"), ("z", None)] + edges[:9]
    df = spark.createDataFrame(edges, "a string, b string")
    assert {tuple(r) for r in components(df).collect()} == plainly(edges)
    assert components(df.limit(0)).count() == 0


def test_hot_keys_take_the_other_way(spark, tmp_path):
    from lexatlas.sources import Workspace, join_hot

    left = Workspace(spark, "t").written(spark.createDataFrame([("h", i) for i in range(50)] + [("k", 1), (None, 2)], "key string, i int"))
    right = spark.createDataFrame([("h", 1), ("k", 2), ("m", 3)], "key string, x int")
    assert sorted(map(tuple, join_hot(left, right, "key", hot_rows=20).collect())) == sorted(map(tuple, left.join(right, "key").collect()))


def test_decisions_and_metrics(found, tmp_path, put):
    s = pa.string()
    rows = [("Q1", "Q2", float("nan"), 0.8), ("Q3", "Q3", 1.0, 0.8), ("R1", "R2", 0.9, 0.8), ("U1", "U2", 0.8, 0.8), ("U2", "U3", None, 0.8), ("V2", "V1", 0.1, 0.2), ("V1", "V2", 0.3, 0.2)]
    put(tmp_path, "metrics", rows, a=s, b=s, cosine=pa.float64(), threshold=pa.float64())
    rows = [("R2", "R1", " Distinct", AT), ("R1", "R2", None, AT + dt.timedelta(1)), ("S2", "S1", "MERGE ", AT), ("U1", "U2", "later", AT), ("T1", "T2", "merge", AT), ("T2", "T1", "later", AT + dt.timedelta(1))]
    put(tmp_path, "pair_decisions", rows, a=s, b=s, decision=s, decided_at=pa.timestamp("us", "UTC"))
    assert found("p3_found", tmp_path) == {("S1", "S1"): 1, ("S2", "S1"): 1, ("U1", "U1"): 1, ("U2", "U1"): 1, ("V1", "V1"): 1, ("V2", "V1"): 1}
