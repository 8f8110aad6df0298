import gzip
import json

from lexatlas.sources import files


def test_sorted_sharded_and_back(spark, tmp_path):
    df = spark.createDataFrame([(i % 7 if i % 5 else None, f"v{i}") for i in range(90)], "k int, v string")
    files.write_table(df, f"{tmp_path}/t", ["k", "v"], 3)
    back = spark.read.parquet(f"{tmp_path}/t")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    for part in back.rdd.glom().collect():
        keys = [(r.k is None, r.k or 0, r.v) for r in part]
        assert keys == sorted(keys)
    files.write_shards(df.where("k IS NOT NULL"), f"{tmp_path}/s", "k", 4)
    assert {r.v for r in files.read_shard(spark, f"{tmp_path}/s", "k", 3, 4).collect()} == {r.v for r in df.where("k = 3").collect()}


def test_decisions_keep_nulls_and_quotes(spark, tmp_path):
    rows = [("a", 'say "no", twice', 1), ("b", None, None), ("c", "", 3), ("d", "two\nlines", 4), ("é", "\\", 5)]
    df = spark.createDataFrame(rows, "id string, note string, n int")
    files.write_decisions(df, f"{tmp_path}/d")
    assert sorted(map(tuple, files.read_decisions(spark, f"{tmp_path}/d", "id string, note string, n int").collect())) == sorted(rows)


def test_lines_of_json(spark, tmp_path):
    with gzip.open(f"{tmp_path}/x.jsonl.gz", "wt") as f:
        for i in range(20):
            f.write(json.dumps({"id": i, "who": {"name": f"n{i % 3}"}, "more": ["x"] * 5}) + "\n")
        f.write("{broken\n")
    got = files.read_json_lines(spark, str(tmp_path), "id int, who struct<name: string>", ['"n1"'])
    assert sorted(r.id for r in got.collect()) == [i for i in range(20) if i % 3 == 1]
    assert files.read_json_lines(spark, str(tmp_path), "id int").where("id IS NOT NULL").count() == 20
