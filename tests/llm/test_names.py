import datetime as dt
import random

import pyarrow as pa
import pytest
from conftest import SF

from lexatlas.llm import groups, names

AT = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)


def edits(x, y):
    """Edits with swaps of neighbours, in full."""
    d = {(i, j): max(i, j) for i in range(len(x) + 1) for j in range(len(y) + 1) if not i or not j}
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
            if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(x), len(y)]


def typo(rng, w):
    i = rng.randrange(len(w))
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcd") + w[i:], w[:i] + rng.choice("abcd") + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])


@pytest.mark.parametrize("k", [1, 2])
def test_no_pair_within_k_edits_is_lost(k):
    rng = random.Random(k)
    for _ in range(3000):
        x = "".join(rng.choice("abcd") for _ in range(rng.randrange(4 * k + 2, 12)))
        y = x
        for _ in range(k):
            y = typo(rng, y)
        if edits(x, y) <= k:
            long, short = (x, y) if len(x) >= len(y) else (y, x)
            assert set(names.probe_keys(long, k)) & set(names.index_keys(short, k)), (x, y)


def test_banded_distance():
    rng = random.Random(9)
    for _ in range(3000):
        x = "".join(rng.choice("abc") for _ in range(rng.randrange(4, 9)))
        y = typo(rng, x) if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(rng.randrange(4, 9)))
        for most in (1, 2):
            if min(len(x), len(y)) >= 4:
                assert names.near(x, y, most) == min(edits(x, y), most + 1), (x, y, most)


def test_candidates_against_brute_force(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(5, 9))) for _ in range(30)]
    rows = [(f"p{i:03}", rng.choice(["u1", "u2", None]), typo(rng, rng.choice(base))) for i in range(150)]
    got = {tuple(r) for r in names.candidates(spark.createDataFrame(rows, "id string, unit string, sur string")).collect()}
    for a, ua, x in rows:
        for b, ub, y in rows:
            if a < b and (ua is None or ub is None or ua == ub) and edits(x, y) <= 1:
                assert (a, b) in got
            elif a < b and ua and ub and ua != ub:
                assert (a, b) not in got


def test_people_under_several_spellings(found, tmp_path, put):
    rows = [
        ("P1", "Katherine Basiovic", "u1", "trade"), ("P2", "BASIVIC Kathy", "u1", None), ("P3", "  Basiovic,  K. ", "u1", "trade"),
        ("P4", "Katherine Basiovic", "u2", "trade"), ("P5", "Prof. Jürgen van Zarofesar", "u1", None), ("P6", "juergen zarofesar", "u1", "soil"),
        ("P7", "Priya Povotive", "u1", None), ("P8", "Susanna Povotive", "u1", None), ("P9", "S. Otherwise", "u1", None), ("P10", "Quite Different", "u1", None), ("P9", "S. Otherwise", "u1", None),
        ("Q1", "Hans-Peter T. Netebita", "u3", None), ("Q2", "HP Netebita", "u3", None), ("Q3", "Netebita, H.-P.", None, None), ("N1", None, "u1", None), ("N2", "", None, None), ("N3", "Plato", "u1", None), (None, "K. Basiovic", "u1", None),
        ("R1", "Ada Copyman", "u4", "soil"), ("R2", "Ada Copyman", "u4", "soil"), ("R3", "ADA COPYMAN", "u4", "soil"), ("S1", "Eve Doubleday", "u4", "soil"), ("S2", "Eve Doubleday", "u4", "soil"), ("L1", "x" * 50_000 + " y", "u9", None),
    ]
    s, at = pa.string(), pa.timestamp("us", "UTC")
    put(tmp_path, "persons", [(*r, AT) for r in rows], person_id=s, person=s, unit=s, field=s, retrieved_at=at)
    put(tmp_path, "pair_decisions", [("P9", "P10", "merge", AT), ("S2", "S1", "Distinct", AT), ("N1", "N2", "merge", AT)], a=s, b=s, decision=s, decided_at=at)
    pairs = {("P1", "P2"), ("P1", "P3"), ("P2", "P3"), ("P5", "P6"), ("P10", "P9"), ("Q1", "Q2"), ("Q1", "Q3"), ("Q2", "Q3"), ("R1", "R2"), ("R1", "R3"), ("R2", "R3")}
    assert set(found("p5_found", tmp_path)) - {("N1", "N2")} == pairs
    put(tmp_path, "persons", [], person_id=s, person=s, unit=s, field=s, retrieved_at=at)
    put(tmp_path, "pair_decisions", [], a=s, b=s, decision=s, decided_at=at)
    assert not found("p5_found", tmp_path)


def test_people_as_judged(spark, found):
    got = set(found("p5_found"))
    judged = [tuple(r) for r in groups.latest_decisions(spark, SF).collect()]
    assert {(a, b) for a, b, d in judged if d == "merge"} <= got
    assert not {(a, b) for a, b, d in judged if d == "distinct"} & got
