"""Texts over time: bins, windows of bins, and what people write about in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexatlas.operators.scoring import occurrences
from lexatlas.sources import Workspace, table

NOW, WIDTH, TOP = 2025, 5, 3


def bin_number(year: str) -> Column:
    """Bins count backwards from now: 0 holds the last WIDTH years."""
    return F.floor((NOW - F.col(year)) / WIDTH).cast("int")


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(f"year <= {NOW}").select("doc_id", F.col("lead_pid").alias("pid"), "year", bin_number("year").alias("bin"), F.coalesce(F.length(F.trim("text")) > 0, F.lit(False)).alias("content"))


def tr1_bins(spark, sf_dir):
    return dated(spark, sf_dir).groupBy("bin").agg(F.min(NOW - (F.col("bin") + 1) * WIDTH + 1).alias("first"), F.min(NOW - F.col("bin") * WIDTH).alias("last"), F.count("*").alias("texts"))


def tr2_fingerprints(spark, sf_dir):
    """The keywords that a person uses most in each bin, and the number of texts, blank ones too."""
    space = Workspace(spark, "bins")
    d = space.written(dated(spark, sf_dir).where("pid IS NOT NULL"))
    n = d.groupBy("pid", "bin").agg(F.count("*").alias("texts"), F.sum(F.col("content").cast("int")).alias("with_content"))
    use = occurrences(spark, sf_dir).drop("pid").join(d.select("doc_id", "pid", "bin"), "doc_id").groupBy("pid", "bin", "key").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("pid", "bin").orderBy(F.desc("n"), "key")
    top = use.withColumn("place", F.row_number().over(w)).where(F.col("place") <= TOP)
    top = top.groupBy("pid", "bin").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "key")))["key"], ", ").alias("top"))
    return n.join(top, ["pid", "bin"], "left")


def tr4_windows(spark, sf_dir):
    """All runs of bins of each person, with the texts in them. A person has few bins, however many texts."""
    b = Workspace(spark, "bins").written(dated(spark, sf_dir).where("pid IS NOT NULL").groupBy("pid", "bin").agg(F.count("*").alias("texts")))
    ends = b.select("pid", F.col("bin").alias("from")).join(b.select("pid", F.col("bin").alias("to")), "pid").where("from <= to")
    return ends.join(b, "pid").where("bin BETWEEN from AND to").groupBy("pid", "from", "to").agg(F.sum("texts").alias("texts"))


def tr5_cohorts(spark, sf_dir):
    """Texts and people of each cohort in each bin."""
    p = table(spark, sf_dir, "persons").where("cohort_id IS NOT NULL").select(F.col("person_id").alias("pid"), "cohort_id").distinct()
    x = dated(spark, sf_dir).join(p, "pid").groupBy("cohort_id", "bin", "pid").agg(F.count("*").alias("n"))
    return x.groupBy("cohort_id", "bin").agg(F.sum("n").alias("texts"), F.count("*").alias("people"))


def tr6_fields(spark, sf_dir):
    """The share of each field in the texts of a bin."""
    p = table(spark, sf_dir, "persons").groupBy(F.col("person_id").alias("pid")).agg(F.max("field").alias("field"))
    x = dated(spark, sf_dir).join(p, "pid").where("field IS NOT NULL").groupBy("bin", "field").agg(F.count("*").alias("n"))
    return x.join(x.groupBy("bin").agg(F.sum("n").alias("all")), "bin").select("bin", "field", F.round(F.col("n") / F.col("all"), 6).alias("share"))


QUERIES = {f.__name__: f for f in (tr1_bins, tr2_fingerprints, tr4_windows, tr5_cohorts, tr6_fields)}
B = f"d AS (SELECT doc_id, lead_pid AS pid, year, CAST(floor(({NOW} - year) / {WIDTH}::DOUBLE) AS INTEGER) AS bin, coalesce(length(trim(text, ' ')) > 0, false) AS content FROM documents WHERE year <= {NOW})"
_O = r"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}{2,}') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(list_concat(list_filter(w, lambda x: length(x) >= 4), list_transform(list_filter(range(1, len(w)), lambda i: length(w[i]) >= 4 AND length(w[i + 1]) >= 4), lambda i: w[i] || ' ' || w[i + 1]))) AS key FROM w),
r AS (SELECT pid, bin, key, row_number() OVER (PARTITION BY pid, bin ORDER BY count(*) DESC, key) AS place FROM g JOIN d USING (doc_id) WHERE pid IS NOT NULL GROUP BY pid, bin, key),
"""
SQL = {
    "tr1_bins": f"WITH {B} SELECT bin, min({NOW} - (bin + 1) * {WIDTH} + 1) AS first, min({NOW} - bin * {WIDTH}) AS last, count(*) AS texts FROM d GROUP BY 1",
    "tr2_fingerprints": f"WITH {B}, {_O} t AS (SELECT pid, bin, string_agg(key, ', ' ORDER BY place) AS top FROM r WHERE place <= {TOP} GROUP BY 1, 2), n AS (SELECT pid, bin, count(*) AS texts, CAST(sum(content::INT) AS BIGINT) AS with_content FROM d WHERE pid IS NOT NULL GROUP BY 1, 2) SELECT pid, bin, texts, with_content, top FROM n LEFT JOIN t USING (pid, bin)",
    "tr4_windows": f'WITH {B}, b AS (SELECT pid, bin, count(*) AS texts FROM d WHERE pid IS NOT NULL GROUP BY 1, 2) SELECT x.pid, x.bin AS "from", y.bin AS "to", CAST(sum(z.texts) AS BIGINT) AS texts FROM b x JOIN b y ON x.pid = y.pid AND x.bin <= y.bin JOIN b z ON z.pid = x.pid AND z.bin BETWEEN x.bin AND y.bin GROUP BY 1, 2, 3',
    "tr5_cohorts": f"WITH {B}, p AS (SELECT DISTINCT person_id AS pid, cohort_id FROM persons WHERE cohort_id IS NOT NULL) SELECT cohort_id, bin, count(*) AS texts, count(DISTINCT pid) AS people FROM d JOIN p USING (pid) GROUP BY 1, 2",
    "tr6_fields": f"WITH {B}, p AS (SELECT person_id AS pid, max(field) AS field FROM persons GROUP BY 1), x AS (SELECT bin, field, count(*) AS n FROM d JOIN p USING (pid) WHERE field IS NOT NULL GROUP BY 1, 2) SELECT bin, field, round(n / sum(n) OVER (PARTITION BY bin), 6) AS share FROM x",
}
