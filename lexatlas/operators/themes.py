"""A tree of themes over keywords: the usage that lies in each node, who uses it, and measures of the tree.

The tree has two levels: a keyword of two words lies in the theme of its last word, and that in the group of its first letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexatlas.operators.scoring import latest, occurrences
from lexatlas.sources import Workspace, table

TOP, MANY = 15, 2


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, key, theme, area, n): use of the keywords that are in the tree."""
    o = occurrences(spark, sf_dir).where("pid IS NOT NULL AND key LIKE '% %'").groupBy("pid", "key").agg(F.sum("n").alias("n"))
    theme = F.substring_index("key", " ", -1)
    return o.select("pid", "key", theme.alias("theme"), F.substring(theme, 1, 1).alias("area"), "n")


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """placed, with the share of each keyword in its person's use."""
    p = Workspace(spark, "themes").written(placed(spark, sf_dir))
    return p.join(p.groupBy("pid").agg(F.sum("n").alias("all")), "pid").withColumn("share", F.col("n") / F.col("all")).drop("all")


def th5_people(spark, sf_dir):
    """The weight of each area in each person's use."""
    return shares(spark, sf_dir).groupBy("pid", "area").agg(F.sum("n").alias("n"), F.round(F.sum("share"), 6).alias("share"))


def th5_nodes(spark, sf_dir):
    """The weight of each theme: the shares of its keywords summed over people, and its people."""
    s = shares(spark, sf_dir).groupBy("area", "theme", "pid").agg(F.sum("share").alias("share"))
    return s.groupBy("area", "theme").agg(F.round(F.sum("share"), 5).alias("weight"), F.count("*").alias("people"))


def th5_top(spark, sf_dir):
    """The keywords of each area that are used most."""
    k = placed(spark, sf_dir).groupBy("area", "key").agg(F.sum("n").alias("n"))
    return k.withColumn("place", F.row_number().over(Window.partitionBy("area").orderBy(F.desc("n"), "key"))).where(F.col("place") <= TOP)


def by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, area, mean): the mean share of each area over the people of a field."""
    p = table(spark, sf_dir, "persons").groupBy(F.col("person_id").alias("pid")).agg(F.max("field").alias("field")).where("field IS NOT NULL")
    s = Workspace(spark, "themes").written(shares(spark, sf_dir).groupBy("pid", "area").agg(F.sum("share").alias("share")).join(p, "pid"))
    size = s.select("field", "pid").distinct().groupBy("field").agg(F.count("*").alias("people"))
    return s.groupBy("field", "area").agg(F.sum("share").alias("share")).join(size, "field").select("field", "area", (F.col("share") / F.col("people")).alias("mean"))


def th5_units(spark, sf_dir):
    return by_field(spark, sf_dir).withColumn("mean", F.round("mean", 5))


def mp4_path(spark, sf_dir):
    """The heaviest area of each person, and the heaviest theme in it."""
    p = Workspace(spark, "themes").written(placed(spark, sf_dir))
    best = lambda df, c: df.groupBy("pid").agg(F.min(F.struct((-F.col("n")).alias("k"), c)).alias("x")).select("pid", f"x.{c}")
    area = best(p.groupBy("pid", "area").agg(F.sum("n").alias("n")), "area")
    return area.join(best(p.groupBy("pid", "area", "theme").agg(F.sum("n").alias("n")).join(area, ["pid", "area"], "left_semi"), "theme"), "pid")


def q17_heaviest(spark, sf_dir):
    """Per theme its people, and the share of its use that its two heaviest users hold."""
    p = placed(spark, sf_dir).groupBy("theme", "pid").agg(F.sum("n").alias("n"))
    r = p.withColumn("place", F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("n"), "pid"))).where(F.col("place") <= MANY)
    heavy = r.groupBy("theme").agg(F.sum("n").alias("heavy"))
    return p.groupBy("theme").agg(F.count("*").alias("people"), F.sum("n").alias("n")).join(heavy, "theme").select("theme", "people", F.round(F.col("heavy") / F.col("n"), 6).alias("held"))


def q1_themes(spark, sf_dir):
    """How much two fields write about the same areas: the sum of the smaller share of each area."""
    u = Workspace(spark, "themes").written(by_field(spark, sf_dir))
    return u.toDF("field_a", "area", "mean_a").join(u.toDF("field_b", "area", "mean_b"), "area").where("field_a < field_b").groupBy("field_a", "field_b").agg(F.round(F.sum(F.least("mean_a", "mean_b")), 4).alias("overlap"))


def th15_balance(spark, sf_dir):
    """Themes of each area, keywords in them, and how uneven the themes are (deviation over mean)."""
    t = latest(spark, sf_dir).where("term LIKE '% %'").select("term").distinct().groupBy(F.substring_index("term", " ", -1).alias("theme")).agg(F.count("*").alias("n"))
    return t.groupBy(F.substring("theme", 1, 1).alias("area")).agg(F.count("*").alias("themes"), F.sum("n").alias("keywords"), F.round(F.stddev_pop("n") / F.avg("n"), 5).alias("cv"))


def th15_bcubed(spark, sf_dir):
    """B-cubed precision and recall of areas against the first words of keywords, from the counts of each pair of classes, not from pairs of keywords."""
    k = latest(spark, sf_dir).where("term LIKE '% %'").select("term").distinct().select(F.substring(F.substring_index("term", " ", -1), 1, 1).alias("c"), F.substring_index("term", " ", 1).alias("t"))
    m = Workspace(spark, "themes").written(k.groupBy("c", "t").agg(F.count("*").alias("n")))
    x = m.join(m.groupBy("c").agg(F.sum("n").alias("nc")), "c").join(m.groupBy("t").agg(F.sum("n").alias("nt")), "t")
    n2 = F.col("n") * F.col("n")
    return x.agg(F.sum("n").alias("keywords"), F.round(F.sum(n2 / F.col("nc")) / F.sum("n"), 6).alias("precision"), F.round(F.sum(n2 / F.col("nt")) / F.sum("n"), 6).alias("recall"))


QUERIES = {f.__name__: f for f in (th5_people, th5_nodes, th5_top, th5_units, mp4_path, q17_heaviest, q1_themes, th15_balance, th15_bcubed)}
PL = r"""
w AS (SELECT lead_pid AS pid, regexp_extract_all(lower(text), '\p{L}{2,}') AS w FROM documents WHERE text IS NOT NULL AND lead_pid IS NOT NULL),
g AS (SELECT pid, unnest(list_transform(list_filter(range(1, len(w)), lambda i: length(w[i]) >= 4 AND length(w[i + 1]) >= 4), lambda i: w[i] || ' ' || w[i + 1])) AS key FROM w),
pl AS (SELECT pid, key, split_part(key, ' ', 2) AS theme, left(split_part(key, ' ', 2), 1) AS area, count(*) AS n FROM g GROUP BY 1, 2, 3, 4),
sh AS (SELECT *, n / sum(n) OVER (PARTITION BY pid) AS share FROM pl)
"""
U = "p AS (SELECT person_id AS pid, max(field) AS field FROM persons GROUP BY 1), a AS (SELECT pid, field, area, sum(share) AS share FROM sh JOIN p USING (pid) WHERE field IS NOT NULL GROUP BY 1, 2, 3), z AS (SELECT field, count(DISTINCT pid) AS people FROM a GROUP BY 1), u AS (SELECT field, area, sum(share) / any_value(people) AS mean FROM a JOIN z USING (field) GROUP BY 1, 2)"
V = "v AS (SELECT DISTINCT lower(trim(term, ' ')) AS term FROM vocabulary v JOIN cohorts c ON v.cohort_id = c.cohort_id AND v.exported_at = c.exported_at), k AS (SELECT term, split_part(term, ' ', -1) AS theme FROM v WHERE term LIKE '% %')"
SQL = {
    "th5_people": f"WITH {PL} SELECT pid, area, CAST(sum(n) AS BIGINT) AS n, round(sum(share), 6) AS share FROM sh GROUP BY 1, 2",
    "th5_nodes": f"WITH {PL} SELECT area, theme, round(sum(share), 5) AS weight, count(DISTINCT pid) AS people FROM sh GROUP BY 1, 2",
    "th5_top": f"WITH {PL}, r AS (SELECT area, key, sum(n) AS n, row_number() OVER (PARTITION BY area ORDER BY sum(n) DESC, key) AS place FROM pl GROUP BY 1, 2) SELECT area, key, CAST(n AS BIGINT) AS n, CAST(place AS INTEGER) AS place FROM r WHERE place <= {TOP}",
    "th5_units": f"WITH {PL}, {U} SELECT field, area, round(mean, 5) AS mean FROM u",
    "mp4_path": f"WITH {PL}, a AS (SELECT pid, area, row_number() OVER (PARTITION BY pid ORDER BY sum(n) DESC, area) AS k FROM pl GROUP BY 1, 2), t AS (SELECT pid, area, theme, row_number() OVER (PARTITION BY pid, area ORDER BY sum(n) DESC, theme) AS k FROM pl GROUP BY 1, 2, 3) SELECT pid, area, theme FROM a JOIN t USING (pid, area) WHERE a.k = 1 AND t.k = 1",
    "q17_heaviest": f"WITH {PL}, p AS (SELECT theme, pid, sum(n) AS n, row_number() OVER (PARTITION BY theme ORDER BY sum(n) DESC, pid) AS k FROM pl GROUP BY 1, 2) SELECT theme, count(*) AS people, round(sum(CASE WHEN k <= {MANY} THEN n END) / sum(n), 6) AS held FROM p GROUP BY 1",
    "q1_themes": f"WITH {PL}, {U} SELECT x.field AS field_a, y.field AS field_b, round(sum(least(x.mean, y.mean)), 4) AS overlap FROM u x JOIN u y USING (area) WHERE x.field < y.field GROUP BY 1, 2",
    "th15_balance": f"WITH {V}, t AS (SELECT theme, count(*) AS n FROM k GROUP BY 1) SELECT left(theme, 1) AS area, count(*) AS themes, CAST(sum(n) AS BIGINT) AS keywords, round(stddev_pop(n) / avg(n), 5) AS cv FROM t GROUP BY 1",
    "th15_bcubed": f"WITH {V}, m AS (SELECT left(theme, 1) AS c, split_part(term, ' ', 1) AS t, count(*) AS n FROM k GROUP BY 1, 2), x AS (SELECT n, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER (PARTITION BY t) AS nt FROM m) SELECT CAST(sum(n) AS BIGINT) AS keywords, round(sum(n * n / nc) / sum(n), 6) AS precision, round(sum(n * n / nt) / sum(n), 6) AS recall FROM x",
}
