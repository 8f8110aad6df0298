"""Items that appear together (problem 1): an incremental table of pairs.

Changed baskets emit signed deltas of pairs and of single items, which are merged into persistent counts in hash buckets; the
association scores whose counts changed are recomputed. A basket given again replaces what it gave before, so a batch may be
replayed, and a basket without items, or with more than `most` of them, takes back all it gave.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.sources import Workspace, join_hot, table

MOST_PIDS, LEAST_TOGETHER, LEAST_LIFT = 25, 5, 8
SCHEMAS = {
    "baskets": "bucket int, basket string, items array<string>",
    "items": "bucket int, item string, n long",
    "pairs": "bucket int, a string, b string, n long",
    "scores": "bucket int, a string, b string, n_ab long, n_a long, n_b long",
}


class PairTable:
    """Counts of items and pairs over baskets, in `buckets` hash buckets under `path`; only the buckets that a batch touches are written anew.

    A manifest names the version of every bucket. It is written last, so a batch that fails halfway leaves the former state in place.
    most: baskets with more distinct items count for nothing (None: no such limit). buckets: choose it so that one bucket fits a task.
    """

    def __init__(self, spark: SparkSession, path: str, most: int | None = MOST_PIDS, buckets: int = 24):
        self.spark, self.path, self.most, self.buckets = spark, path, most, buckets
        self.space = Workspace(spark, "pairs")
        self.version, self.total, self.at = 0, 0, {name: {} for name in SCHEMAS}
        versions = [int(v) for v in self.space.folders(f"{path}/manifest")]
        if versions:
            state = json.loads(spark.read.text(f"{path}/manifest/{max(versions)}", wholetext=True).first()[0])
            self.version, self.total = max(versions), state["total"]
            self.at = {name: {int(b): v for b, v in x.items()} for name, x in state["at"].items()}

    def bucket(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def read(self, name: str, only: set[int] | None = None) -> DataFrame:
        """A table of the state, or some of its buckets."""
        paths = [f"{self.path}/{name}/{v}/at={b}" for b, v in sorted(self.at[name].items()) if only is None or b in only]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def _touched(self, df: DataFrame) -> set[int]:
        return {r[0] for r in df.select("bucket").distinct().collect()}

    def _replace(self, at: dict, name: str, df: DataFrame, touched: set[int]) -> None:
        """Writes the touched buckets of a table, one file each."""
        path = f"{self.path}/{name}/{self.version + 1}"
        df.withColumn("at", F.col("bucket")).repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("at").parquet(path)
        there = {int(x.removeprefix("at=")) for x in self.space.folders(path) if x.startswith("at=")}
        at[name] = {b: v for b, v in self.at[name].items() if b not in touched} | {b: self.version + 1 for b in there}

    def _merge(self, at: dict, name: str, delta: DataFrame, keys: list[str]) -> None:
        """Adds signed deltas to the counts of their buckets; what comes to nothing goes."""
        touched = self._touched(delta)
        both = self.read(name, touched).unionByName(delta).repartition(self.buckets, "bucket")
        self._replace(at, name, both.groupBy("bucket", *keys).agg(F.sum("n").alias("n")).where("n > 0"), touched)

    def apply(self, changes: DataFrame) -> PairTable:
        """Takes (basket, item): the whole new contents of every basket that changed; rows repeat freely. A basket with null items only is withdrawn.

        Rows with a null basket are left out; so are null items.
        """
        space, at = self.space, dict(self.at)
        rows = space.written(changes.where("basket IS NOT NULL").select(F.col("basket").cast("string"), F.col("item").cast("string")).distinct())
        sizes = rows.groupBy("basket").agg(F.count("item").alias("k"))
        fits = sizes.where("k > 0" if self.most is None else f"k BETWEEN 1 AND {self.most}").select("basket")
        new = rows.where("item IS NOT NULL").join(fits, "basket", "left_semi").groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("new"))
        named = sizes.select("basket", self.bucket("basket").alias("bucket"))
        old = self.read("baskets", self._touched(named)).select("basket", F.col("items").alias("old"))
        change = named.join(new, "basket", "left").join(old, "basket", "left").where(~F.col("new").eqNullSafe(F.col("old")))
        change = space.written(change.select("bucket", "basket", "old", "new"))

        signed = change.select(F.explode(F.array(F.struct(F.lit(1).alias("d"), F.col("new").alias("s")), F.struct(F.lit(-1).alias("d"), F.col("old").alias("s")))).alias("x"))
        signed = signed.select("x.d", "x.s").where("s IS NOT NULL")
        each = signed.select("d", F.posexplode("s").alias("i", "a"), "s")
        d_items = each.groupBy(F.col("a").alias("item")).agg(F.sum("d").alias("n")).where("n <> 0")
        d_items = space.written(d_items.select(self.bucket("item").alias("bucket"), "item", "n"))
        d_pairs = each.select("d", "a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("b")).groupBy("a", "b").agg(F.sum("d").alias("n")).where("n <> 0")
        d_pairs = space.written(d_pairs.select(self.bucket("a", "b").alias("bucket"), "a", "b", "n"))
        self.total += change.agg(F.coalesce(F.sum(F.col("new").isNotNull().cast("int") - F.col("old").isNotNull().cast("int")), F.lit(0))).first()[0]

        touched = self._touched(change)
        kept = self.read("baskets", touched).join(change.select("basket"), "basket", "left_anti")
        self._replace(at, "baskets", kept.select("bucket", "basket", "items").unionByName(change.where("new IS NOT NULL").select("bucket", "basket", F.col("new").alias("items"))), touched)
        self._merge(at, "items", d_items, ["item"])
        self._merge(at, "pairs", d_pairs, ["a", "b"])
        self.at = self.at | {name: at[name] for name in ("baskets", "items", "pairs")}
        self._rescore(at, d_items, d_pairs)
        self.at, self.version = at, self.version + 1
        state = json.dumps({"total": self.total, "at": at})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{self.version}")
        return self

    def _rescore(self, at: dict, d_items: DataFrame, d_pairs: DataFrame) -> None:
        """The scores of pairs whose own count or either marginal changed; N enters on reading, as it changes with every basket."""
        pairs, moved = self.read("pairs"), d_items.select("item")
        if self.at["scores"]:
            affected = pairs.join(moved.withColumnRenamed("item", "a"), "a", "left_semi").select("bucket", "a", "b", "n")
            affected = affected.unionByName(pairs.join(moved.withColumnRenamed("item", "b"), "b", "left_semi").select("bucket", "a", "b", "n"))
            affected = self.space.written(affected.unionByName(pairs.join(d_pairs.select("a", "b"), ["a", "b"], "left_semi").select("bucket", "a", "b", "n")).distinct())
        else:
            affected = pairs  # none had a score before
        n = self.read("items")
        scored = self.space.written(join_hot(affected, n.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a"))
        scored = join_hot(scored, n.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b").select("bucket", "a", "b", F.col("n").alias("n_ab"), "n_a", "n_b")
        gone = affected.select("a", "b").unionByName(d_pairs.select("a", "b"))
        touched = self._touched(affected.select("bucket").unionByName(d_pairs.select("bucket")))
        still = self.read("scores", touched).join(gone, ["a", "b"], "left_anti").select("bucket", "a", "b", "n_ab", "n_a", "n_b")
        self._replace(at, "scores", still.unionByName(scored), touched)

    def associations(self, least: int = 1, lift: float = 0) -> DataFrame:
        """(a, b, n_ab, n_a, n_b, n, lift) of pairs found together at least so often, and so many times as often as chance. Compared in whole numbers."""
        long = lambda c: F.col(c).cast("decimal(19,0)")
        s = self.read("scores").where(F.col("n_ab") >= least).withColumn("n", F.lit(self.total).cast("long"))
        if lift:
            s = s.where(long("n_ab") * long("n") >= F.lit(lift).cast("decimal(10,4)") * (long("n_a") * long("n_b")).cast("decimal(27,0)"))
        return s.select("a", "b", "n_ab", "n_a", "n_b", "n", (F.col("n_ab") * F.col("n").cast("double") / (F.col("n_a") * F.col("n_b").cast("double"))).alias("lift"))


def coauthors(spark: SparkSession, sf_dir: str, batches: int = 2) -> PairTable:
    """The pair table of all texts of authorships, taken in as so many batches of whole texts."""
    a = table(spark, sf_dir, "authorships").select(F.col("tid").alias("basket"), F.col("pid").alias("item"))
    pairs = PairTable(spark, Workspace(spark, "coauthors").path)
    for k in range(batches):
        pairs.apply(a.where(F.pmod(F.xxhash64("basket"), F.lit(batches)) == k))
    return pairs


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1: pairs that sign at least 5 texts together and 8 times as many as chance. Texts with more than 25 people are left out, as the problem says."""
    return coauthors(spark, sf_dir).associations(LEAST_TOGETHER, LEAST_LIFT).select(F.col("a").alias("pid_a"), F.col("b").alias("pid_b"))


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1: the counts and the lift of all pairs with at least 5 texts together."""
    return coauthors(spark, sf_dir).associations(LEAST_TOGETHER).select(F.col("a").alias("pid_a"), F.col("b").alias("pid_b"), "n_ab", "n_a", "n_b", "n", "lift")
