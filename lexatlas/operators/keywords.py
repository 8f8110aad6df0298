"""Keywords: bands and gates, aliases, facets, sets, and who shares them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexatlas.functions.text import singular
from lexatlas.operators.graph import signed
from lexatlas.operators.scoring import CONCEPTS, LATEST, OCC, SINGULAR, concepts, latest, occurrences, tfidf
from lexatlas.operators.texts import vocabulary
from lexatlas.sources import Workspace, table

KEEP, CHECK, LEAST_COHORTS = 20.0, 5.0, 2
REJECTED, KEPT = ("coral reef", "data"), ("sensor",)


def agg8_bands(spark, sf_dir):
    """The band of each concept and the first reason for it."""
    c, words = concepts(spark, sf_dir), F.size(F.split("term", " "))
    reason = F.when(F.length("term") < 3, "short").when(F.col("cohorts") < LEAST_COHORTS, "few").when(F.col("score") < CHECK, "low").when(words > 4, "long").when(F.col("score") < KEEP, "middle").otherwise("good")
    band = F.when(reason == "good", "kept").when(reason.isin("middle", "few"), "check").otherwise("aside")
    return c.select("term", band.alias("band"), reason.alias("reason"))


def agg9_rejects(spark, sf_dir):
    """Bands with earlier rejections laid over them."""
    b = agg8_bands(spark, sf_dir)
    return b.select("term", F.when(F.col("term").isin(*REJECTED), "rejected").otherwise(F.col("band")).alias("band"))


def agg15_accepted(spark, sf_dir):
    """Concepts that pass: kept ones before rejected ones before bands."""
    b = agg8_bands(spark, sf_dir)
    return b.where(F.col("term").isin(*KEPT) | (~F.col("term").isin(*REJECTED) & (F.col("band") == "kept"))).select("term")


def flt4_preview(spark, sf_dir):
    """How many concepts each reason names, before and after a threshold is raised by half."""
    c = concepts(spark, sf_dir)
    band = lambda k: F.when(F.col("score") < CHECK * k, "low").when(F.col("score") < KEEP * k, "middle").otherwise("good")
    return c.select(band(1).alias("before"), band(1.5).alias("after")).groupBy("before", "after").agg(F.count("*").alias("n"))


def flt3_facets(spark, sf_dir):
    """Facets of concepts: cohorts and number of words."""
    return concepts(spark, sf_dir).groupBy("cohorts", F.size(F.split("term", " ")).alias("words")).agg(F.count("*").alias("n"), F.count(F.when(F.contains("term", F.lit("sand")), 1)).alias("matching"))


def agg18_forms(spark, sf_dir):
    """The concept of each spelling: that of the highest score, then the first."""
    v = vocabulary(spark, sf_dir).where("score_total IS NOT NULL").select(F.lower(F.trim("term")).alias("form"), F.trim("term").alias("concept"), "score_total").where("form <> ''")
    return v.groupBy("form").agg(F.min(F.struct((-F.col("score_total")).alias("s"), "concept")).alias("x")).select("form", "x.concept")


def agg21_folded(spark, sf_dir):
    """Counts of singular and plural folded into one."""
    key = F.array_join(F.transform(F.split("term", " "), singular), " ")
    return latest(spark, sf_dir).groupBy("cohort_id", key.alias("key")).agg(F.sum("tf").alias("tf"), F.count("*").alias("forms"))


def agg25_domain(spark, sf_dir):
    """The 50 terms of most people over all cohorts."""
    return latest(spark, sf_dir).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("cohorts")).orderBy(F.desc("n"), "term").limit(50)


def agg27_merged(spark, sf_dir):
    """Terms of all exports by their highest score, above a floor."""
    v = vocabulary(spark, sf_dir).select(F.lower(F.trim("term")).alias("term"), "score_total").where("term <> '' AND score_total IS NOT NULL")
    return v.groupBy("term").agg(F.max("score_total").alias("score")).where(F.col("score") >= CHECK)


def set4_overlap(spark, sf_dir):
    """Jaccard of the sets of terms of two cohorts, and how much of each lies in the other. Through shared terms."""
    v = Workspace(spark, "sets").written(latest(spark, sf_dir).select("cohort_id", "term"))
    size = v.groupBy("cohort_id").agg(F.count("*").alias("n"))
    both = v.toDF("a", "term").join(v.toDF("b", "term"), "term").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    x = both.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    return x.select("a", "b", "both", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("jaccard"), F.round(F.col("both") / F.least("na", "nb"), 6).alias("inside"))


def set3_changes(spark, sf_dir):
    """Terms that came, went or changed from one cohort to another."""
    v = Workspace(spark, "sets").written(latest(spark, sf_dir))
    a, b = (v.where(F.col("cohort_id") == c).select("term", F.col("n").alias(f"n{i}")) for i, c in enumerate(("C000001", "C000002")))
    kind = F.when(F.col("n0").isNull(), "came").when(F.col("n1").isNull(), "went").when(F.col("n0") != F.col("n1"), "changed").otherwise("same")
    return a.join(b, "term", "full").select("term", kind.alias("kind"))


def win3_fused(spark, sf_dir):
    """One value of each field for an organisation's people: by source in order, then the latest, then the value."""
    rank = F.when(F.col("source") == "registry", 1).when(F.col("source") == "person", 2).otherwise(3)
    best = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(rank.alias("r"), (-F.unix_micros("retrieved_at")).alias("t"), F.col(c).alias("v"))))["v"].alias(c)
    return table(spark, sf_dir, "affiliations").where("person_id IS NOT NULL AND org_id IS NOT NULL").groupBy("person_id", "org_id").agg(best("start_year"), best("end_year"), F.count_distinct("source").alias("sources"))


def win6_recent(spark, sf_dir):
    """The five latest texts of each person."""
    d = table(spark, sf_dir, "documents").where("year IS NOT NULL").select(F.col("text_id").alias("tid"), "year")
    w = Window.partitionBy("pid").orderBy(F.desc("year"), "tid")
    return signed(spark, sf_dir).join(d, "tid").withColumn("place", F.row_number().over(w)).where("place <= 5")


def jn8_duplicates(spark, sf_dir):
    """Texts with the same words: each with the first of its group, and how many people signed both."""
    p = table(spark, sf_dir, "documents").where("length(text) >= 25 AND text_id IS NOT NULL").select("text_id", F.sha2(F.lower(F.trim("text")), 256).alias("title")).distinct()
    first = p.groupBy("title").agg(F.min("text_id").alias("first"), F.count("*").alias("texts")).where("texts > 1")
    x = Workspace(spark, "titles").written(p.join(first, "title").where("text_id <> first").select("text_id", "first").distinct())
    s = signed(spark, sf_dir)
    both = x.join(s.toDF("text_id", "pid"), "text_id").join(s.toDF("first", "pid"), ["first", "pid"]).groupBy("text_id", "first").agg(F.count("*").alias("shared"))
    return x.join(both, ["text_id", "first"], "left").fillna(0, ["shared"])


def jn12_product(spark, sf_dir):
    """Fields by keywords: the product of people's fields and people's use, for keywords of ten people at least."""
    f = table(spark, sf_dir, "persons").groupBy(F.col("person_id").alias("pid")).agg(F.max("field").alias("field")).where("field IS NOT NULL")
    o = Workspace(spark, "product").written(occurrences(spark, sf_dir).where("pid IS NOT NULL").groupBy("pid", "key").agg(F.sum("n").alias("n")))
    many = o.groupBy("key").count().where("count >= 10").select("key")
    return o.join(many, "key", "left_semi").join(f, "pid").groupBy("field", "key").agg(F.sum("n").alias("n"))


def gr7_fit(spark, sf_dir):
    """How near each person's keywords are to those of the three first people: a cosine of dampened counts by idf."""
    o = Workspace(spark, "fit").written(occurrences(spark, sf_dir).where("pid IS NOT NULL").groupBy("pid", "key").agg(F.sum("n").alias("n")))
    people = o.select("pid").distinct().count()
    seeds = o.select("pid").distinct().orderBy("pid").limit(3)
    df = o.groupBy("key").agg(F.count("*").alias("df"))
    w = o.join(df, "key").select("pid", "key", ((1 + F.log("n")) * (1 + F.log((1 + F.lit(people)) / (1 + F.col("df"))))).alias("w"))
    w = Workspace(spark, "fit").written(w.join(w.groupBy("pid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l")), "pid").select("pid", "key", (F.col("w") / F.col("l")).alias("w")))
    c = w.join(seeds, "pid", "left_semi").groupBy("key").agg(F.sum("w").alias("c"))
    length = c.agg(F.sqrt(F.sum(F.col("c") * F.col("c")))).first()[0] or 1.0
    return w.join(c, "key").groupBy("pid").agg(F.round(F.sum(F.col("w") * F.col("c")) / F.lit(length), 3).alias("fit"))


def q18_cousers(spark, sf_dir):
    """Keywords that the most people share with the keyword of most people."""
    u = Workspace(spark, "users").written(occurrences(spark, sf_dir).where("pid IS NOT NULL").select("pid", "key").distinct())
    n = u.groupBy("key").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "key").limit(1)
    own = u.join(top.select("key"), "key", "left_semi").select("pid")
    both = u.join(own, "pid", "left_semi").groupBy("key").agg(F.count("*").alias("both")).join(n, "key")
    return both.join(top.select("key"), "key", "left_anti").orderBy(F.desc("both"), "key").limit(30)


def q12_histogram(spark, sf_dir):
    """Scores by order of magnitude."""
    return concepts(spark, sf_dir).where("score > 0").groupBy(F.floor(F.log10("score")).alias("magnitude")).agg(F.count("*").alias("n"), F.max("score").alias("most"))


def sp2_text_tfidf(spark, sf_dir):
    """Texts by keywords that they have at all, weighted by idf, of length one; the weights of each text's first keyword."""
    o = occurrences(spark, sf_dir).withColumn("n", F.lit(1))
    o = Workspace(spark, "texts").written(o)
    w = tfidf(o, o.select("doc_id").distinct().count())
    return w.groupBy("doc_id").agg(F.count("*").alias("keywords"), F.round(F.max("w"), 4).alias("most"))


def sp5_presence(spark, sf_dir):
    """Texts by the keywords of the vocabularies that they hold."""
    v = latest(spark, sf_dir).select(F.col("term").alias("key")).distinct()
    return occurrences(spark, sf_dir).join(v, "key", "left_semi").groupBy("doc_id").agg(F.count("*").alias("keywords"), F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (
    agg8_bands, agg9_rejects, agg15_accepted, agg18_forms, agg21_folded, agg25_domain, agg27_merged, flt3_facets, flt4_preview, set3_changes, set4_overlap, win3_fused, win6_recent, jn8_duplicates, jn12_product,
    gr7_fit, q12_histogram, q18_cousers, sp2_text_tfidf, sp5_presence,
)}

_BANDS = f"""{CONCEPTS}, r AS (SELECT term, CASE WHEN length(term) < 3 THEN 'short' WHEN cohorts < {LEAST_COHORTS} THEN 'few' WHEN score < {CHECK} THEN 'low' WHEN len(string_split(term, ' ')) > 4 THEN 'long' WHEN score < {KEEP} THEN 'middle' ELSE 'good' END AS reason FROM c),
b AS (SELECT term, CASE WHEN reason = 'good' THEN 'kept' WHEN reason IN ('middle', 'few') THEN 'check' ELSE 'aside' END AS band, reason FROM r)"""
_IN = lambda x: "(" + ", ".join(map(repr, x)) + ("" if x else "''") + ")"
_band = lambda k: f"CASE WHEN score < {CHECK * k} THEN 'low' WHEN score < {KEEP * k} THEN 'middle' ELSE 'good' END"
_S = "s AS (SELECT DISTINCT tid, pid FROM authorships WHERE tid IS NOT NULL AND pid IS NOT NULL)"
_F = "f AS (SELECT person_id AS pid, max(field) AS field FROM persons GROUP BY 1)"
_RANK = "{'r': CASE source WHEN 'registry' THEN 1 WHEN 'person' THEN 2 ELSE 3 END, 't': -epoch_us(retrieved_at), 'v': %s}"
SQL = {
    "agg8_bands": f"WITH {_BANDS} SELECT term, band, reason FROM b",
    "agg9_rejects": f"WITH {_BANDS} SELECT term, CASE WHEN term IN {_IN(REJECTED)} THEN 'rejected' ELSE band END AS band FROM b",
    "agg15_accepted": f"WITH {_BANDS} SELECT term FROM b WHERE term IN {_IN(KEPT)} OR (term NOT IN {_IN(REJECTED)} AND band = 'kept')",
    "flt4_preview": f"WITH {CONCEPTS} SELECT {_band(1)} AS before, {_band(1.5)} AS after, count(*) AS n FROM c GROUP BY 1, 2",
    "flt3_facets": f"WITH {CONCEPTS} SELECT cohorts, CAST(len(string_split(term, ' ')) AS INTEGER) AS words, count(*) AS n, count(*) FILTER (contains(term, 'sand')) AS matching FROM c GROUP BY 1, 2",
    "agg18_forms": "WITH v AS (SELECT lower(trim(term, ' ')) AS form, trim(term, ' ') AS concept, row_number() OVER (PARTITION BY lower(trim(term, ' ')) ORDER BY score_total DESC, trim(term, ' ')) AS k FROM vocabulary WHERE term IS NOT NULL AND score_total IS NOT NULL) SELECT form, concept FROM v WHERE k = 1 AND form <> ''",
    "agg21_folded": f"WITH {LATEST} SELECT cohort_id, {SINGULAR} AS key, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS forms FROM v GROUP BY 1, 2",
    "agg25_domain": f"WITH {LATEST} SELECT term, CAST(sum(n) AS BIGINT) AS n, count(*) AS cohorts FROM v GROUP BY 1 ORDER BY sum(n) DESC, term LIMIT 50",
    "agg27_merged": f"SELECT lower(trim(term, ' ')) AS term, max(score_total) AS score FROM vocabulary WHERE trim(term, ' ') <> '' AND score_total IS NOT NULL GROUP BY 1 HAVING max(score_total) >= {CHECK}",
    "set3_changes": f"WITH {LATEST}, a AS (SELECT term, n FROM v WHERE cohort_id = 'C000001'), b AS (SELECT term, n FROM v WHERE cohort_id = 'C000002') SELECT coalesce(a.term, b.term) AS term, CASE WHEN a.n IS NULL THEN 'came' WHEN b.n IS NULL THEN 'went' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS kind FROM a FULL JOIN b ON a.term = b.term",
    "set4_overlap": f'WITH {LATEST}, z AS (SELECT cohort_id, count(*) AS n FROM v GROUP BY 1), m AS (SELECT x.cohort_id AS a, y.cohort_id AS b, count(*) AS "both" FROM v x JOIN v y USING (term) WHERE x.cohort_id < y.cohort_id GROUP BY 1, 2) SELECT a, b, "both", round("both" / (p.n + q.n - "both"), 6) AS jaccard, round("both" / least(p.n, q.n), 6) AS inside FROM m JOIN z p ON p.cohort_id = a JOIN z q ON q.cohort_id = b',
    "win3_fused": "SELECT person_id, org_id, " + ", ".join(f"(min(CASE WHEN {c} IS NOT NULL THEN {_RANK % c} END)).v AS {c}" for c in ("start_year", "end_year")) + ", count(DISTINCT source) AS sources FROM affiliations WHERE person_id IS NOT NULL AND org_id IS NOT NULL GROUP BY 1, 2",
    "win6_recent": f"WITH {_S}, r AS (SELECT tid, pid, year, row_number() OVER (PARTITION BY pid ORDER BY year DESC, tid) AS place FROM s JOIN documents d ON d.text_id = s.tid WHERE year IS NOT NULL) SELECT tid, pid, year, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5",
    "jn8_duplicates": f"WITH {_S}, p AS (SELECT DISTINCT text_id, lower(trim(text, ' ')) AS title FROM documents WHERE length(text) >= 25 AND text_id IS NOT NULL), g AS (SELECT DISTINCT text_id, min(text_id) OVER (PARTITION BY title) AS first FROM p) SELECT text_id, first, (SELECT count(*) FROM s x JOIN s y ON x.pid = y.pid WHERE x.tid = g.text_id AND y.tid = g.first) AS shared FROM g WHERE text_id <> first",
    "jn12_product": f"WITH {OCC}, {_F} SELECT field, key, CAST(sum(n) AS BIGINT) AS n FROM pk JOIN k USING (key) JOIN f USING (pid) WHERE people >= 10 AND field IS NOT NULL GROUP BY 1, 2",
    "gr7_fit": f"WITH {OCC}, np AS (SELECT count(DISTINCT pid) AS np FROM pk), sd AS (SELECT DISTINCT pid FROM pk ORDER BY pid LIMIT 3), w0 AS (SELECT pid, key, (1 + ln(n)) * (1 + ln((1 + np) / (1 + people)::DOUBLE)) AS w FROM pk JOIN k USING (key), np), w1 AS (SELECT pid, key, w / sqrt(sum(w * w) OVER (PARTITION BY pid)) AS w FROM w0), c AS (SELECT key, sum(w) AS c FROM w1 WHERE pid IN (FROM sd) GROUP BY 1) SELECT pid, round(sum(w * c) / (SELECT sqrt(sum(c * c)) FROM c), 3) AS fit FROM w1 JOIN c USING (key) GROUP BY 1",
    "q12_histogram": f"WITH {CONCEPTS} SELECT CAST(floor(log10(score)) AS BIGINT) AS magnitude, count(*) AS n, max(score) AS most FROM c WHERE score > 0 GROUP BY 1",
    "q18_cousers": f'WITH {OCC}, top AS (SELECT key FROM k ORDER BY people DESC, key LIMIT 1), own AS (SELECT pid FROM pk WHERE key IN (FROM top)) SELECT key, count(*) AS "both", any_value(people) AS n FROM pk JOIN k USING (key) WHERE pid IN (FROM own) AND key NOT IN (FROM top) GROUP BY 1 ORDER BY count(*) DESC, key LIMIT 30',
    "sp2_text_tfidf": f"WITH {OCC}, d AS (SELECT key, count(*) AS df FROM o GROUP BY 1), x AS (SELECT doc_id, ln((1 + (SELECT count(DISTINCT doc_id) FROM o)) / (1 + df)::DOUBLE) + 1 AS w FROM o JOIN d USING (key)) SELECT doc_id, count(*) AS keywords, round(max(w) / sqrt(sum(w * w)), 4) AS most FROM x GROUP BY 1",
    "sp5_presence": f"WITH {OCC}, {LATEST.replace('w0 AS', 'wx AS').replace('w AS (SELECT cohort_id, term, w / sqrt', 'wy AS (SELECT cohort_id, term, w / sqrt').replace('FROM w0', 'FROM wx').replace('p AS (', 'p9 AS (')} SELECT doc_id, count(*) AS keywords, CAST(sum(n) AS BIGINT) AS n FROM o WHERE key IN (SELECT term FROM v) GROUP BY 1",
}
