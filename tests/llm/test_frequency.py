from collections import Counter

import pyarrow as pa

from lexatlas.llm.frequency import term_form, totals


def test_splitting_changes_nothing(spark):
    rows = [(f"t{i % 70}" if i % 3 else "hot", i) for i in range(900)] + [(None, 5), ("t1", None)]
    df = spark.createDataFrame(rows, "term string, n long")
    want, records = Counter(), Counter()
    for t, n in rows:
        if t:
            want[t] += n or 0
            records[t] += 1
    for bits, most in ((1, 8), (2, 20), (4, 10**6), (3, 0)):  # down to single terms, which no bits can split
        got = totals(spark, df.repartition(3), ["n"], bits=bits, most_rows=most).collect()
        assert {r.term: (r.n, r.records) for r in got} == {t: (want[t], records[t]) for t in want} and len(got) == len(want)


def test_forms():
    assert term_form("  Été  x Y ") == "été x y" and term_form("  \t") is None


def test_exports_blanks_and_repeats(spark, found, tmp_path, put):
    import datetime as dt

    old, new = (dt.datetime(y, 1, 1, tzinfo=dt.timezone.utc) for y in (2020, 2021))
    s, n, at = pa.string(), pa.int64(), pa.timestamp("us", "UTC")
    put(tmp_path, "cohorts", [("c1", 10, new), ("c2", 10, old), ("c3", None, None)], cohort_id=s, n_entities=n, exported_at=at)
    rows = [("c1", "A b", 2, 1, new), ("c1", "A b", 2, 1, new), ("c1", "a  B", 3, 1, new), ("c1", "a b", 9, 1, old), ("c2", "z", 2, 4, old), ("c2", " ", 1, 1, old), ("c2", None, 1, 1, old), ("c3", "q", 1, 1, None), ("c1", "w" * 100_000, 4, 1, new)]
    put(tmp_path, "vocabulary", rows, cohort_id=s, term=s, n_entities=n, tf_total=n, exported_at=at)
    assert found("p2_terms", tmp_path) == {("a b", 5, 2, 2, "common"): 1, ("z", 2, 4, 1, "rare"): 1, ("w" * 100_000, 4, 1, 1, None): 1}
    put(tmp_path, "vocabulary", [], cohort_id=s, term=s, n_entities=n, tf_total=n, exported_at=at)
    assert not found("p2_found", tmp_path)
