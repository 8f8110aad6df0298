from collections import Counter
from itertools import combinations

import pyarrow as pa

from lexatlas.llm.cooccurrence import PairTable


def plainly(baskets, most):
    ok = {k: set(v) for k, v in baskets.items() if 0 < len(set(v)) <= most}
    n = Counter(i for s in ok.values() for i in s)
    ab = Counter(p for s in ok.values() for p in combinations(sorted(s), 2))
    return {(a, b, k, n[a], n[b], len(ok)) for (a, b), k in ab.items()}


def test_changes_withdrawals_and_replays(spark, tmp_path):
    df = lambda baskets: spark.createDataFrame([(k, i) for k, v in baskets.items() for i in (v or [None])], "basket string, item string")
    got = lambda t: {tuple(r)[:6] for r in t.associations().collect()}
    one = {"t1": "abc", "t2": "ab", "t3": "bcd", "t4": "abcdef", "t5": "a", "t6": "cd"}
    two = {"t2": "acd", "t4": "ab", "t3": "", "t7": "bcaa", "t1": "abcdefg"}
    t = PairTable(spark, str(tmp_path / "s"), most=5, buckets=4).apply(df(one))
    assert got(t) == plainly(one, 5)
    t.apply(df(two))
    want = plainly(one | two, 5)
    assert got(t) == want
    t.apply(df(two))  # a batch given again changes nothing
    assert got(t) == want
    again = PairTable(spark, str(tmp_path / "s"), most=5, buckets=4)  # the state is on disk
    assert again.version == 3 and got(again) == want
    again.apply(df({"t5": "bd", "t9": "ad"}))
    assert got(again) == plainly(one | two | {"t5": "bd", "t9": "ad"}, 5)
    at_once = PairTable(spark, str(tmp_path / "o"), most=5, buckets=3).apply(df(one | two | {"t5": "bd", "t9": "ad"}))
    assert got(at_once) == got(again)


def test_nulls_and_empty_tables(found, tmp_path, put):
    s = pa.string()
    put(tmp_path, "authorships", [], tid=s, pid=s)
    assert not found("p1_found", tmp_path)
    rows = [(f"t{i}", p) for i in range(6) for p in ("x", "y", None)] + [(None, "x")] * 9 + [(f"o{i}", f"z{i}") for i in range(60)]
    put(tmp_path, "authorships", rows + rows[:3], tid=s, pid=s)
    assert found("p1_found", tmp_path) == {("x", "y"): 1}
