"""Consolidating pairwise matches into groups (problem 3) by deterministic Borůvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.sources import Workspace, join_hot, table

#: The components with an edge at least halve in every round, and a path halves with every doubling.
MOST_ROUNDS = 64


def _roots(space: Workspace, parent: DataFrame) -> DataFrame:
    """(node, root) of (node, parent), by pointer doubling until nothing moves; a root is its own parent."""
    for _ in range(MOST_ROUNDS):
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        after = space.written(join_hot(parent, up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
        space.drop(parent)
        moved = not after.where("moved").isEmpty()
        parent = after.select("node", "parent")
        parent._lexatlas_path = after._lexatlas_path
        if not moved:
            return parent.withColumnRenamed("parent", "root")
    raise RuntimeError("pointer doubling didn't end: parent isn't a forest")


def components(edges: DataFrame) -> DataFrame:
    """(id, group) of every node of edges (a, b): group is the smallest id that it reaches, directly or indirectly.

    Each round, every component selects its smallest outgoing edge, in the order of (smaller end, larger end), which is the same seen from
    both sides; so the selected edges form trees, but for pairs that select the same edge, where the smaller end becomes the root. Trees
    collapse by pointer doubling, edges are relabelled by roots, loops and repeats go, until no edge is left. Null ends and loops are left out.
    """
    space = Workspace(edges.sparkSession, "groups")
    e = space.written(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    ends = space.written(e.select(F.col("u").alias("id")).union(e.select("v")).distinct())
    labels = space.written(ends.select("id", F.col("id").alias("root")))
    for _ in range(MOST_ROUNDS):
        if e.isEmpty():
            break
        least = F.min(F.struct("u", "v"))  # combined before the shuffle, so a hub sends one row from each task
        hook = e.select(F.col("u").alias("node"), "u", "v").union(e.select(F.col("v").alias("node"), "u", "v")).groupBy("node").agg(least.alias("x"))
        hook = space.written(hook.select("node", F.when(F.col("node") == F.col("x.u"), F.col("x.v")).otherwise(F.col("x.u")).alias("parent")))
        back = hook.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        mutual = (F.col("above") == F.col("node")) & (F.col("node") < F.col("parent"))
        forest = space.written(join_hot(hook, back, "parent").select("node", F.when(mutual, F.col("node")).otherwise(F.col("parent")).alias("parent")))
        space.drop(hook)
        roots = _roots(space, forest)
        half = space.written(join_hot(e, roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").select("v", "ru"))
        now = join_hot(half, roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v").where("ru <> rv")
        now = space.written(now.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        after = space.written(join_hot(labels, roots.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root")))
        for old in (e, half, labels):
            space.drop(old)
        e, labels = now, after
    else:
        raise RuntimeError("edges are left after the last round")
    least = space.written(labels.groupBy("root").agg(F.min("id").alias("group")))
    return join_hot(labels, least, "root").select("id", "group")


def ordered(df: DataFrame) -> DataFrame:
    """a and b of each pair in either order, the smaller first; a record against itself is no pair."""
    rest = [c for c in df.columns if c not in ("a", "b")]
    return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *rest)


def latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, decision) with a < b: the latest decision of each pair that has one, without case and outer spaces."""
    d = table(spark, sf_dir, "pair_decisions").select("a", "b", "decided_at", F.lower(F.trim("decision")).alias("decision")).where("decision IS NOT NULL")
    return ordered(d).groupBy("a", "b").agg(F.max(F.struct("decided_at", "decision")).alias("x")).select("a", "b", "x.decision")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b) of every linked pair: decided merge at last, or close in any run and not decided distinct at last."""
    decided = latest_decisions(spark, sf_dir)
    known = "cosine IS NOT NULL AND threshold IS NOT NULL AND NOT isnan(cosine) AND NOT isnan(threshold) AND cosine >= threshold"
    close = ordered(table(spark, sf_dir, "metrics").where(known).select("a", "b")).distinct().join(decided.where("decision = 'distinct'"), ["a", "b"], "left_anti")
    return close.unionByName(decided.where("decision = 'merge'").select("a", "b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3: the group of every linked record."""
    return components(links(spark, sf_dir)).select(F.col("id").alias("person_id"), F.col("group").alias("group_id"))
