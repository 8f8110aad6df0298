import random

import pyarrow as pa

from lexatlas.operators.intervals import gaps, periods


def test_open_nested_touching_and_swapped(found, tmp_path, put):
    rows = [("A", 1990, 2003), ("A", 1995, 1996), ("A", 2004, 2005), ("A", 2008, 9999), ("B", None, 1980), ("B", 1985, None), ("C", 2010, 2000), ("C", 2001, 2002), (None, 1, 2), ("D", 0, 1990), ("D", 1970, 1980), ("A", 1990, 2003)]
    put(tmp_path, "affiliations", rows, person_id=pa.string(), start_year=pa.int32(), end_year=pa.int32())
    assert found("p4_found", tmp_path) == {("A", 2006, 2007): 1, ("B", 1981, 1984): 1}
    assert found("p4_periods", tmp_path) == {("A", 1990, 2005): 1, ("A", 2008, None): 1, ("B", None, 1980): 1, ("B", 1985, None): 1, ("C", 2001, 2002): 1, ("D", None, 1990): 1}


def test_empty(found, tmp_path, put):
    put(tmp_path, "affiliations", [], person_id=pa.string(), start_year=pa.int32(), end_year=pa.int32())
    assert not found("p4_found", tmp_path) and not found("p4_periods", tmp_path)


def test_against_sets_of_years(spark):
    rng = random.Random(5)
    rows = [(e, s, s + rng.randrange(4)) for e in range(40) for s in (rng.randrange(30) for _ in range(rng.randrange(1, 9)))]
    df = spark.createDataFrame(rows, "k int, a long, b long")
    want_gaps, want = set(), set()
    for e in range(40):
        years = {y for k, a, b in rows if k == e for y in range(a, b + 1)}
        inside = [y in years for y in range(-1, 40)]
        edges = [i - 1 for i in range(1, len(inside)) if inside[i] != inside[i - 1]]
        runs = list(zip(edges[::2], (y - 1 for y in edges[1::2])))
        want |= {(e, *r) for r in runs}
        want_gaps |= {(e, x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])}
    assert {tuple(r) for r in periods(df, "k", "a", "b").collect()} == want
    assert {tuple(r) for r in gaps(df, "k", "a", "b").collect()} == want_gaps
