"""Counting, scoring and consolidating terms, over texts and over the vocabularies of cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexatlas.functions.text import grams, singular, words
from lexatlas.operators.texts import terms, vocabulary
from lexatlas.sources import Workspace, table

LEAST_PEOPLE, MOST_SHARE, MOST_TERMS, NESTED = 3, 0.5, 200, 1.3


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pid, key, n): how often each keyword occurs in each text."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.col("lead_pid").alias("pid"), F.explode(grams("text")).alias("key")).groupBy("doc_id", "pid", "key").agg(F.count("*").alias("n"))


def by_key(o: DataFrame) -> DataFrame:
    """(key, occurrences, texts, people) of occurrences."""
    # people are counted from pairs, so a frequent keyword never gathers its people in one place
    people = o.where("pid IS NOT NULL").select("key", "pid").distinct().groupBy("key").agg(F.count("*").alias("people"))
    return o.groupBy("key").agg(F.sum("n").alias("occurrences"), F.count("*").alias("texts")).join(people, "key", "left").fillna(0, ["people"])


def ext4_keywords(spark, sf_dir):
    return by_key(occurrences(spark, sf_dir))


def ext5_surfaces(spark, sf_dir):
    """The most frequent spelling of each word; of those as frequent, the first."""
    w = table(spark, sf_dir, "documents").select(F.explode(words("text", r"(\p{L}{4,})")).alias("surface")).groupBy("surface").count()
    best = F.min(F.struct((-F.col("count")).alias("n"), "surface"))
    return w.groupBy(F.lower("surface").alias("key")).agg(best.alias("x"), F.sum("count").alias("n")).select("key", "x.surface", "n")


def ext9_users(spark, sf_dir):
    """The people who use a keyword, for keywords of few people."""
    u = occurrences(spark, sf_dir).where("pid IS NOT NULL").select("key", "pid").distinct()
    return u.join(u.groupBy("key").count().where("count <= 5").select("key"), "key", "left_semi")


def agg1_window(spark, sf_dir):
    """Keywords of enough people and not too many; of those the most frequent."""
    o = Workspace(spark, "scoring").written(occurrences(spark, sf_dir))
    rows = o.agg(F.count_distinct("pid")).first()[0]
    k = by_key(o).where((F.col("people") >= LEAST_PEOPLE) & (F.col("people") <= MOST_SHARE * rows))
    return k.orderBy(F.desc("occurrences"), "key").limit(MOST_TERMS).select("key", "occurrences", "people")


def agg2_votes(spark, sf_dir):
    """Votes for a keyword by frequency, by presence, and dampened."""
    return occurrences(spark, sf_dir).groupBy("key").agg(F.sum("n").alias("frequency"), F.count("*").alias("presence"), F.round(F.sum(1 + F.log("n")), 5).alias("sublinear"))


def agg3_units(spark, sf_dir):
    """Texts of a keyword by the field of their first author: a text counts once in a field."""
    p = table(spark, sf_dir, "persons").where("field IS NOT NULL").select(F.col("person_id").alias("pid"), "field").distinct()
    return occurrences(spark, sf_dir).join(p, "pid").select("key", "field", "doc_id").distinct().groupBy("key", "field").agg(F.count("*").alias("texts"))


def tfidf(o: DataFrame, n_rows: int) -> DataFrame:
    """(doc_id, key, w): smooth tf-idf, of length one in each text. n_rows counts texts without keywords too."""
    df = o.groupBy("key").agg(F.count("*").alias("df"))
    w = o.join(df, "key").select("doc_id", "key", (F.col("n") * (F.log((1 + F.lit(n_rows)) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "doc_id").select("doc_id", "key", (F.col("w") / F.col("norm")).alias("w"))


def agg4_tfidf(spark, sf_dir):
    o = Workspace(spark, "scoring").written(occurrences(spark, sf_dir))
    n = table(spark, sf_dir, "documents").where("text IS NOT NULL").count()
    return tfidf(o, n).groupBy("key").agg(F.round(F.sum("w"), 5).alias("score"))


def agg6_percentiles(spark, sf_dir):
    """The share of other keywords that have fewer people, those with as many counted half. Ranks come from a histogram, which is as short as there are different numbers of people."""
    k = Workspace(spark, "scoring").written(by_key(occurrences(spark, sf_dir)))
    h = k.groupBy("people").agg(F.count("*").alias("same"))
    below = h.alias("x").join(h.select(F.col("people").alias("q"), F.col("same").alias("s")), F.col("q") < F.col("people"), "left").groupBy("people", "same").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("below"))
    n = k.count()
    return k.join(below, "people").select("key", F.round((F.col("below") + (F.col("same") - 1) / 2) / (n - 1), 6).alias("percentile"))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, score, cohorts) of the terms of all vocabularies in lower case."""
    v = vocabulary(spark, sf_dir).where("score_total IS NOT NULL").select(F.lower(F.trim("term")).alias("term"), "cohort_id", "score_total").where("term <> ''")
    one = v.groupBy("term", "cohort_id").agg(F.max("score_total").alias("s"))
    return one.groupBy("term").agg(F.round(F.sum("s"), 4).alias("score"), F.count("*").alias("cohorts"))


def agg10_order(spark, sf_dir):
    """One row for each term of a cohort, that of the highest score."""
    v = vocabulary(spark, sf_dir).where("score_total IS NOT NULL").select("cohort_id", F.lower(F.trim("term")).alias("key"), "score_total", "term")
    best = F.min(F.struct((-F.col("score_total")).alias("s"), "term"))
    return v.groupBy("cohort_id", "key").agg(best.alias("x")).select("cohort_id", "key", "x.term", (-F.col("x.s")).alias("score"))


def agg12_number(spark, sf_dir):
    """Singular and plural under the form of the higher score."""
    c = concepts(spark, sf_dir).withColumn("key", F.array_join(F.transform(F.split("term", " "), singular), " "))
    return c.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "term")).alias("x"), F.count("*").alias("forms")).select("key", "x.term", "forms")


def agg13_concepts(spark, sf_dir):
    return concepts(spark, sf_dir)


def agg14_nested(spark, sf_dir):
    """Terms that stay: a term goes if a longer term that contains it, word by word, scores nearly as much. Met through the first word of the shorter term."""
    c = Workspace(spark, "scoring").written(concepts(spark, sf_dir).select("term", "score", F.split("term", " ").alias("w")))
    short = c.select(F.col("term").alias("short"), F.element_at("w", 1).alias("word"))
    long = c.where("size(w) > 1").select(F.col("term").alias("long"), F.col("score").alias("s"), F.explode(F.array_distinct("w")).alias("word"))
    inside = short.join(long, "word").where((F.length("long") > F.length("short")) & F.contains(F.concat(F.lit(" "), "long", F.lit(" ")), F.concat(F.lit(" "), "short", F.lit(" "))))
    most = inside.groupBy(F.col("short").alias("term")).agg(F.max("s").alias("most"))
    return c.join(most, "term", "left").where((F.col("most").isNull()) | (F.col("score") >= NESTED * F.col("most"))).select("term", "score")


def agg16_top(spark, sf_dir):
    return concepts(spark, sf_dir).orderBy(F.desc("score"), "term").limit(100).select("term", "score")


def agg19_counts(spark, sf_dir):
    """How often each person uses the terms of the vocabularies."""
    o = occurrences(spark, sf_dir).where("pid IS NOT NULL")
    return o.join(terms(spark, sf_dir).withColumnRenamed("term", "key"), "key", "left_semi").groupBy("pid", "key").agg(F.sum("n").alias("n"))


def agg20_plain(spark, sf_dir):
    """The idf of each keyword, by which tf-idf is divided to get plain counts."""
    o = Workspace(spark, "scoring").written(occurrences(spark, sf_dir))
    n = table(spark, sf_dir, "documents").where("text IS NOT NULL").count()
    return o.groupBy("key").agg(F.count("*").alias("df")).select("key", F.round(F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1, 6).alias("idf"))


def agg23_listed(spark, sf_dir):
    """The 30 best terms of each cohort. Spark keeps the best of each task before the shuffle."""
    v = agg10_order(spark, sf_dir)
    w = Window.partitionBy("cohort_id").orderBy(F.desc("score"), "key")
    return v.withColumn("place", F.row_number().over(w)).where("place <= 30").select("cohort_id", "key", "place")


def agg24_per_field(spark, sf_dir):
    """The 10 keywords that the people of a field use most, on average over all its people."""
    p = table(spark, sf_dir, "persons").where("field IS NOT NULL").select(F.col("person_id").alias("pid"), "field").distinct()
    size = p.groupBy("field").agg(F.count("*").alias("size"))
    use = occurrences(spark, sf_dir).join(p, "pid").groupBy("field", "key").agg(F.sum("n").alias("n")).join(size, "field")
    w = Window.partitionBy("field").orderBy(F.desc("n"), "key")
    return use.withColumn("place", F.row_number().over(w)).where("place <= 10").select("field", "key", F.round(F.col("n") / F.col("size"), 6).alias("mean"), "place")


def agg26_matrix(spark, sf_dir):
    """People by keywords that at least three people use, as shares of each person's use."""
    o = Workspace(spark, "scoring").written(occurrences(spark, sf_dir).where("pid IS NOT NULL").groupBy("pid", "key").agg(F.sum("n").alias("n")))
    kept = o.join(o.groupBy("key").count().where(F.col("count") >= LEAST_PEOPLE).select("key"), "key", "left_semi")
    return kept.join(kept.groupBy("pid").agg(F.sum("n").alias("all")), "pid").select("pid", "key", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def q5_users(spark, sf_dir):
    """Who uses a keyword most: the ten first people of each keyword that at least 20 people use."""
    o = Workspace(spark, "scoring").written(occurrences(spark, sf_dir).where("pid IS NOT NULL").groupBy("pid", "key").agg(F.sum("n").alias("n")))
    many = o.groupBy("key").agg(F.count("*").alias("users")).where("users >= 20")
    w = Window.partitionBy("key").orderBy(F.desc("n"), "pid")
    return o.join(many, "key").withColumn("place", F.row_number().over(w)).where("place <= 10").select("key", "pid", "n", "users", "place")


# cohorts


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cohort_id, term, n, tf, score): the latest export of each cohort, spellings made one."""
    c = table(spark, sf_dir, "cohorts").select("cohort_id", "exported_at")
    v = vocabulary(spark, sf_dir).join(c, ["cohort_id", "exported_at"], "left_semi").distinct()
    v = v.select("cohort_id", F.lower(F.trim("term")).alias("term"), "n_entities", "tf_total", "score_total").where("term <> ''")
    return v.groupBy("cohort_id", "term").agg(F.sum("n_entities").alias("n"), F.sum("tf_total").alias("tf"), F.round(F.sum("score_total"), 4).alias("score"))


def mg20_bundle(spark, sf_dir):
    return latest(spark, sf_dir)


def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, df, idf), pooled over all cohorts."""
    people = table(spark, sf_dir, "cohorts").agg(F.sum("n_entities")).first()[0] or 0
    return latest(spark, sf_dir).groupBy("term").agg(F.sum("n").alias("df")).withColumn("idf", F.log((1 + F.lit(people)) / (1 + F.col("df"))) + 1)


def mg7_idf(spark, sf_dir):
    return idf(spark, sf_dir).select("term", "df", F.round("idf", 6).alias("idf"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cohort_id, term, w): dampened counts by idf, longer terms raised, of length one in each cohort."""
    v = latest(spark, sf_dir).where("tf > 0").join(idf(spark, sf_dir).select("term", "idf"), "term")
    w = v.select("cohort_id", "term", ((1 + F.log("tf")) * F.col("idf") * (1 + 2.0 * (F.size(F.split("term", " ")) - 1))).alias("w"))
    return w.join(w.groupBy("cohort_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "cohort_id").select("cohort_id", "term", (F.col("w") / F.col("norm")).alias("w"))


def mg8_weights(spark, sf_dir):
    return weights(spark, sf_dir).select("cohort_id", "term", F.round("w", 6).alias("w"))


def _cohort_pairs(x: DataFrame) -> DataFrame:
    """Rows of two cohorts that meet in a term. Cohorts are few, so a term has at most as many rows squared."""
    return x.toDF(*(f"{c}_a" if c != "term" else c for c in x.columns)).join(x.toDF(*(f"{c}_b" if c != "term" else c for c in x.columns)), "term").where("cohort_id_a < cohort_id_b")


def mg17_shared_mass(spark, sf_dir):
    """The mass that the vocabularies of two cohorts share: the sum of the smaller share of each term."""
    v = latest(spark, sf_dir).where("tf > 0").select("cohort_id", "term", "tf")
    p = v.join(v.groupBy("cohort_id").agg(F.sum("tf").alias("all")), "cohort_id").select("cohort_id", "term", (F.col("tf") / F.col("all")).alias("p"))
    return _cohort_pairs(p).groupBy("cohort_id_a", "cohort_id_b").agg(F.round(F.sum(F.least("p_a", "p_b")), 6).alias("mass"))


def mg2_jaccard(spark, sf_dir):
    """Weighted Jaccard of two cohorts: sum of the smaller over sum of the larger counts."""
    v = Workspace(spark, "cohorts").written(latest(spark, sf_dir).where("tf > 0").select("cohort_id", "term", "tf"))
    all_ = v.groupBy("cohort_id").agg(F.sum("tf").alias("all"))
    both = _cohort_pairs(v).groupBy("cohort_id_a", "cohort_id_b").agg(F.sum(F.least("tf_a", "tf_b")).alias("least"))
    both = both.join(all_.toDF("cohort_id_a", "all_a"), "cohort_id_a").join(all_.toDF("cohort_id_b", "all_b"), "cohort_id_b")
    return both.select("cohort_id_a", "cohort_id_b", F.round(F.col("least") / (F.col("all_a") + F.col("all_b") - F.col("least")), 6).alias("jaccard"))


def jn10_cosine(spark, sf_dir):
    """Cosines of cohorts, through the terms they share."""
    return _cohort_pairs(weights(spark, sf_dir)).groupBy("cohort_id_a", "cohort_id_b").agg(F.round(F.sum(F.col("w_a") * F.col("w_b")), 5).alias("cosine"))


def set2_gaps(spark, sf_dir):
    """Terms of the first cohort that no other has, and of others that the first lacks."""
    v = latest(spark, sf_dir).select("cohort_id", "term")
    first = v.where("cohort_id = 'C000001'").select("term")
    rest = v.where("cohort_id <> 'C000001'").select("term").distinct()
    return first.exceptAll(rest).select("term", F.lit("extra").alias("kind")).union(rest.exceptAll(first).select("term", F.lit("missing")))


def win1_top(spark, sf_dir):
    w = Window.partitionBy("cohort_id").orderBy(F.desc("n"), "term")
    return latest(spark, sf_dir).withColumn("place", F.row_number().over(w)).where("place <= 3").select("cohort_id", "term", "n", "place")


QUERIES = {f.__name__: f for f in (
    ext4_keywords, ext5_surfaces, ext9_users, agg1_window, agg2_votes, agg3_units, agg4_tfidf, agg6_percentiles, agg10_order, agg12_number, agg13_concepts, agg14_nested, agg16_top, agg19_counts, agg20_plain,
    agg23_listed, agg24_per_field, agg26_matrix, q5_users, mg20_bundle, mg7_idf, mg8_weights, mg17_shared_mass, mg2_jaccard, jn10_cosine, set2_gaps, win1_top,
)}
OCC = r"""
w AS (SELECT doc_id, lead_pid AS pid, regexp_extract_all(lower(text), '\p{L}{2,}') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, pid, unnest(list_concat(list_filter(w, lambda x: length(x) >= 4), list_transform(list_filter(range(1, len(w)), lambda i: length(w[i]) >= 4 AND length(w[i + 1]) >= 4), lambda i: w[i] || ' ' || w[i + 1]))) AS key FROM w),
o AS (SELECT doc_id, pid, key, count(*) AS n FROM g GROUP BY ALL),
k AS (SELECT key, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS texts, count(DISTINCT pid) AS people FROM o GROUP BY 1),
pk AS (SELECT pid, key, CAST(sum(n) AS BIGINT) AS n FROM o WHERE pid IS NOT NULL GROUP BY ALL)
"""
FIELDS = "f AS (SELECT DISTINCT person_id AS pid, field FROM persons WHERE field IS NOT NULL)"
TEXTS = "(SELECT count(*) FROM documents WHERE text IS NOT NULL)"
IDF = f"(ln((1 + {TEXTS}) / (1 + df)::DOUBLE) + 1)"
CONCEPTS = """
v1 AS (SELECT lower(trim(term, ' ')) AS term, cohort_id, max(score_total) AS s FROM vocabulary WHERE term IS NOT NULL AND score_total IS NOT NULL GROUP BY ALL),
c AS (SELECT term, round(sum(s), 4) AS score, count(*) AS cohorts FROM v1 WHERE term <> '' GROUP BY 1)
"""
ORDERED = "b AS (SELECT cohort_id, lower(trim(term, ' ')) AS key, term, score_total AS score, row_number() OVER (PARTITION BY cohort_id, lower(trim(term, ' ')) ORDER BY score_total DESC, term) AS k FROM vocabulary WHERE term IS NOT NULL AND score_total IS NOT NULL)"
SINGULAR = """array_to_string(list_transform(string_split(term, ' '), lambda w: CASE WHEN w LIKE '%eaux' THEN left(w, length(w) - 1) WHEN w LIKE '%aux' THEN left(w, length(w) - 2) || 'l' WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END), ' ')"""
LATEST = """
v0 AS (SELECT DISTINCT v.* FROM vocabulary v JOIN cohorts c ON v.cohort_id = c.cohort_id AND v.exported_at = c.exported_at WHERE term IS NOT NULL),
v AS (SELECT cohort_id, lower(trim(term, ' ')) AS term, CAST(sum(n_entities) AS BIGINT) AS n, CAST(sum(tf_total) AS BIGINT) AS tf, round(sum(score_total), 4) AS score FROM v0 WHERE trim(term, ' ') <> '' GROUP BY 1, 2),
i AS (SELECT term, CAST(sum(n) AS BIGINT) AS df, ln((1 + (SELECT sum(n_entities) FROM cohorts)) / (1 + sum(n))::DOUBLE) + 1 AS idf FROM v GROUP BY 1),
w0 AS (SELECT cohort_id, term, (1 + ln(tf)) * idf * (1 + 2.0::DOUBLE * (len(string_split(term, ' ')) - 1)) AS w FROM v JOIN i USING (term) WHERE tf > 0),
w AS (SELECT cohort_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY cohort_id)) AS w FROM w0),
p AS (SELECT cohort_id, term, tf, tf / sum(tf) OVER (PARTITION BY cohort_id) AS p FROM v WHERE tf > 0)
"""
SQL = {
    "ext4_keywords": f"WITH {OCC} SELECT * FROM k",
    "ext5_surfaces": r"WITH s AS (SELECT unnest(regexp_extract_all(text, '\p{L}{4,}')) AS surface FROM documents), c AS (SELECT surface, count(*) AS n FROM s GROUP BY 1), r AS (SELECT lower(surface) AS key, surface, sum(n) OVER (PARTITION BY lower(surface)) AS n, row_number() OVER (PARTITION BY lower(surface) ORDER BY n DESC, surface) AS k FROM c) SELECT key, surface, CAST(n AS BIGINT) AS n FROM r WHERE k = 1",
    "ext9_users": f"WITH {OCC} SELECT key, pid FROM pk JOIN k USING (key) WHERE people <= 5",
    "agg1_window": f"WITH {OCC} SELECT key, occurrences, people FROM k WHERE people >= {LEAST_PEOPLE} AND people <= {MOST_SHARE} * (SELECT count(DISTINCT pid) FROM o) ORDER BY occurrences DESC, key LIMIT {MOST_TERMS}",
    "agg2_votes": f"WITH {OCC} SELECT key, CAST(sum(n) AS BIGINT) AS frequency, count(*) AS presence, round(sum(1 + ln(n)), 5) AS sublinear FROM o GROUP BY 1",
    "agg3_units": f"WITH {OCC}, {FIELDS} SELECT key, field, count(DISTINCT doc_id) AS texts FROM o JOIN f USING (pid) GROUP BY 1, 2",
    "agg4_tfidf": f"WITH {OCC}, d AS (SELECT key, count(*) AS df FROM o GROUP BY 1), x AS (SELECT doc_id, key, n * {IDF} AS w FROM o JOIN d USING (key)), y AS (SELECT key, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM x) SELECT key, round(sum(w), 5) AS score FROM y GROUP BY 1",
    "agg6_percentiles": f"WITH {OCC} SELECT key, round((rank() OVER (ORDER BY people) - 1 + (count(*) OVER (PARTITION BY people) - 1) / 2) / (count(*) OVER () - 1), 6) AS percentile FROM k",
    "agg10_order": f"WITH {ORDERED} SELECT cohort_id, key, term, score FROM b WHERE k = 1",
    "agg12_number": f"WITH {CONCEPTS}, r AS (SELECT {SINGULAR} AS key, term, score FROM c), s AS (SELECT key, term, count(*) OVER (PARTITION BY key) AS forms, row_number() OVER (PARTITION BY key ORDER BY score DESC, term) AS k FROM r) SELECT key, term, forms FROM s WHERE k = 1",
    "agg13_concepts": f"WITH {CONCEPTS} SELECT * FROM c",
    "agg14_nested": f"WITH {CONCEPTS} SELECT term, score FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE length(y.term) > length(x.term) AND contains(' ' || y.term || ' ', ' ' || x.term || ' ') AND x.score < {NESTED}::DOUBLE * y.score)",
    "agg16_top": f"WITH {CONCEPTS} SELECT term, score FROM c ORDER BY score DESC, term LIMIT 100",
    "agg19_counts": f"WITH {OCC}, t AS (SELECT DISTINCT lower(trim(term, ' ')) AS key FROM vocabulary) SELECT pid, key, n FROM pk SEMI JOIN t USING (key)",
    "agg20_plain": f"WITH {OCC}, d AS (SELECT key, count(*) AS df FROM o GROUP BY 1) SELECT key, round({IDF}, 6) AS idf FROM d",
    "agg23_listed": f"WITH {ORDERED}, r AS (SELECT cohort_id, key, row_number() OVER (PARTITION BY cohort_id ORDER BY score DESC, key) AS place FROM b WHERE k = 1) SELECT cohort_id, key, CAST(place AS INTEGER) AS place FROM r WHERE place <= 30",
    "agg24_per_field": f"WITH {OCC}, {FIELDS}, s AS (SELECT field, count(*) AS size FROM f GROUP BY 1), u AS (SELECT field, key, sum(n) AS n FROM o JOIN f USING (pid) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, key) AS place FROM u) SELECT field, key, round(n / size, 6) AS mean, CAST(place AS INTEGER) AS place FROM r JOIN s USING (field) WHERE place <= 10",
    "agg26_matrix": f"WITH {OCC}, x AS (SELECT pk.* FROM pk JOIN k USING (key) WHERE people >= {LEAST_PEOPLE}) SELECT pid, key, round(n / sum(n) OVER (PARTITION BY pid), 6) AS share FROM x",
    "q5_users": f"WITH {OCC}, r AS (SELECT key, pid, n, people AS users, row_number() OVER (PARTITION BY key ORDER BY n DESC, pid) AS place FROM pk JOIN k USING (key) WHERE people >= 20) SELECT key, pid, n, users, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10",
    "mg20_bundle": f"WITH {LATEST} SELECT * FROM v",
    "mg7_idf": f"WITH {LATEST} SELECT term, df, round(idf, 6) AS idf FROM i",
    "mg8_weights": f"WITH {LATEST} SELECT cohort_id, term, round(w, 6) AS w FROM w",
    "mg17_shared_mass": f"WITH {LATEST} SELECT x.cohort_id AS cohort_id_a, y.cohort_id AS cohort_id_b, round(sum(least(x.p, y.p)), 6) AS mass FROM p x JOIN p y USING (term) WHERE x.cohort_id < y.cohort_id GROUP BY 1, 2",
    "mg2_jaccard": f"WITH {LATEST}, a AS (SELECT cohort_id, sum(tf) AS all_tf FROM p GROUP BY 1), m AS (SELECT x.cohort_id AS ca, y.cohort_id AS cb, sum(least(x.tf, y.tf)) AS l FROM p x JOIN p y USING (term) WHERE x.cohort_id < y.cohort_id GROUP BY 1, 2) SELECT ca AS cohort_id_a, cb AS cohort_id_b, round(l / (x.all_tf + y.all_tf - l), 6) AS jaccard FROM m JOIN a x ON x.cohort_id = ca JOIN a y ON y.cohort_id = cb",
    "jn10_cosine": f"WITH {LATEST} SELECT x.cohort_id AS cohort_id_a, y.cohort_id AS cohort_id_b, round(sum(x.w * y.w), 5) AS cosine FROM w x JOIN w y USING (term) WHERE x.cohort_id < y.cohort_id GROUP BY 1, 2",
    "set2_gaps": f"WITH {LATEST}, a AS (SELECT term FROM v WHERE cohort_id = 'C000001'), b AS (SELECT DISTINCT term FROM v WHERE cohort_id <> 'C000001') SELECT term, 'extra' AS kind FROM a WHERE term NOT IN (FROM b) UNION ALL SELECT term, 'missing' FROM b WHERE term NOT IN (FROM a)",
    "win1_top": f"WITH {LATEST}, r AS (SELECT cohort_id, term, n, row_number() OVER (PARTITION BY cohort_id ORDER BY n DESC, term) AS place FROM v) SELECT cohort_id, term, n, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3",
}
