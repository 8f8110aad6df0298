import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from conftest import SF

from lexatlas.llm import mixing, tokens


def read(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def name(x):
    return re.sub(r"[\W_]", "", (x or "").lower())


def test_shares_shortages_and_repeats(spark):
    enc = tokens.encoding()
    docs, targets = read("documents"), [t for t in read("mix_targets") if t["weight"] > 0]
    n = {r["doc_id"]: len(enc.encode_ordinary(r["text"] or "")) for r in docs}
    of = Counter()
    for r in docs:
        of[name(r["source"])] += n[r["doc_id"]]
    total, weights = sum(of[name(t["source"])] for t in targets), sum(t["weight"] for t in targets)
    plan, mix = mixing._mix(spark, SF)
    rows = mix.collect()
    source = {r["doc_id"]: name(r["source"]) for r in docs}
    assert len({r.doc_id for r in rows}) == len(rows) and all(n[r.doc_id] == r.tokens and source[r.doc_id] == name(r.source) for r in rows)
    shares = {r.source: r for r in mixing.report(plan, mix).collect()}
    assert set(shares) == {t["source"] for t in targets}
    for t in targets:
        own, r = of[name(t["source"])], shares[t["source"]]
        want = t["weight"] / weights * total
        assert r.short == (own * t["max_repeat"] < want)
        times = [x.times for x in rows if x.source == t["source"]]
        assert all(k <= t["max_repeat"] for k in times) and (not times or max(times) - min(times) <= 1)
        budget = min(math.floor(want), own * t["max_repeat"])
        assert r.used <= budget and (budget - r.used <= max([0, *(n[d] for d in n if source[d] == name(t["source"]))]))
    assert {r[0] for r in mixing.p8_found(spark, SF).collect()} == {s for s, r in shares.items() if r.short}


def test_ranges_give_what_one_order_gives(spark):
    import random

    rng = random.Random(4)
    docs = [(i, "ab"[i % 3 == 0], rng.randrange(0, 90), rng.choice((0.1, 0.5, 1.0))) for i in range(700)]
    d = spark.createDataFrame(docs, "doc_id long, key string, tokens long, weight double")
    targets = spark.createDataFrame([("A", 1.0, 5), ("b", 2.0, 9), ("none", 1.0, 3), ("z", 0.0, 1), ("n", None, 1)], "source string, weight double, max_repeat int")
    sizes = d.groupBy("key").agg({"tokens": "sum", "doc_id": "count"}).toDF("key", "tokens", "documents")
    plan = mixing.budgets(sizes, targets)
    assert {r.source: r.short for r in plan.collect()} == {"A": False, "b": False, "none": True}
    one = {tuple(r) for r in mixing.mixed(d, plan, bucket_rows=10**6).collect()}
    many = {tuple(r) for r in mixing.mixed(d, plan, bucket_rows=20).collect()}
    assert one == many and one
    # drawn in proportion to weight: of those in the last epoch, heavy ones are more
    extra = {r[0] for r in one if r[1] == "A" and r[3] == max(x[3] for x in one if x[1] == "A")}
    heavy, light = ([i for i, k, _, w in docs if k == "a" and w == x] for x in (1.0, 0.1))
    assert len(extra & set(heavy)) / len(heavy) > len(extra & set(light)) / len(light)


def test_empty_and_null_texts(spark, found, tmp_path, put):
    s = pa.string()
    put(tmp_path, "mix_targets", [("A b", 1.0, 2), ("c", 1.0, 1)], source=s, weight=pa.float64(), max_repeat=pa.int32())
    put(tmp_path, "documents", [], doc_id=pa.int64(), source=s, text=s)
    assert not found("p8_found", tmp_path)
    put(tmp_path, "documents", [(1, "a-B", "one two"), (2, "AB", None), (3, None, "x"), (4, "q", "x y"), (5, "ab", "")], doc_id=pa.int64(), source=s, text=s)
    assert found("p8_found", tmp_path) == {("c",): 1}
