"""Names of people: folding, keys, agreement, candidates for the same person, masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexatlas.functions.names import agreement, bag, folded, parts
from lexatlas.operators.graph import decided
from lexatlas.sources import table


def named(spark, sf_dir):
    """One name for each person: the first in alphabetical order."""
    return table(spark, sf_dir, "persons").where("person_id IS NOT NULL").groupBy("person_id").agg(F.min("person").alias("person"), F.max("unit").alias("unit"))


def str14_folded(spark, sf_dir):
    return named(spark, sf_dir).select("person_id", folded("person").alias("folded"), bag("person").alias("bag"), F.element_at(parts("person"), -1).alias("surname"))


def str15_ladder(spark, sf_dir):
    """How alike the names of judged pairs are, on a ladder."""
    return str16_agreement(spark, sf_dir).select("a", "b", F.when(F.col("kind") == "same", 1.0).when(F.col("kind") == "order", 0.9).when(F.col("kind") == "initials", 0.85).when(F.col("kind") == "part", 0.75).otherwise(0.0).alias("score"))


def str16_agreement(spark, sf_dir):
    n = named(spark, sf_dir)
    d = decided(spark, sf_dir).select("a", "b").join(n.select(F.col("person_id").alias("a"), parts("person").alias("x")), "a").join(n.select(F.col("person_id").alias("b"), parts("person").alias("y")), "b")
    return d.select("a", "b", agreement(F.col("x"), F.col("y")).alias("kind"))


def jn6_candidates(spark, sf_dir):
    """Records that share a bag of name words in a unit: each with the first of its block, so a block of any size gives as many rows as records."""
    n = named(spark, sf_dir).where("unit IS NOT NULL").select("person_id", "unit", bag("person").alias("bag")).where("bag <> ''")
    block = n.groupBy("unit", "bag").agg(F.min("person_id").alias("first"), F.count("*").alias("crowd")).where("crowd > 1")
    return n.join(block, ["unit", "bag"]).select("person_id", "first", "crowd")


def jn13_namesakes(spark, sf_dir):
    """People of one name who appear for one organisation and sign no text together: per name and organisation how many."""
    n = named(spark, sf_dir).select(F.col("person_id").alias("pid"), bag("person").alias("bag")).where("bag <> ''")
    a = table(spark, sf_dir, "affiliations").where("person_id IS NOT NULL AND org_id IS NOT NULL").select(F.col("person_id").alias("pid"), "org_id").distinct()
    return a.join(n, "pid").groupBy("org_id", "bag").agg(F.count("*").alias("people"), F.min("pid").alias("first")).where("people > 1")


def str28_masked(spark, sf_dir):
    """Texts that hold the surname of their first author, with it masked. The name comes with its text, so nothing is broadcast."""
    n = named(spark, sf_dir).select(F.col("person_id").alias("lead_pid"), F.element_at(parts("person"), -1).alias("surname")).where("length(surname) > 3")
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").join(n, "lead_pid")
    pattern = F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), "surname", F.lit(r"($|[^\p{L}\p{N}_])"))
    return d.select("doc_id", F.md5(F.regexp_replace(F.lower("text"), pattern, F.lit("$1[person]$2"))).alias("digest"))


QUERIES = {f.__name__: f for f in (str14_folded, str15_ladder, str16_agreement, jn6_candidates, jn13_namesakes, str28_masked)}
_X = "replace(replace(replace(lower(person), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"
N = f"""
n0 AS (SELECT person_id, min(person) AS person, max(unit) AS unit FROM persons WHERE person_id IS NOT NULL GROUP BY 1),
n1 AS (SELECT *, trim(regexp_replace(translate({_X}, 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿł', 'aaaaaaceeeeiiiinoooooouuuuyyl'), '[^a-z,]+', ' ', 'g'), ' ') AS folded FROM n0),
n2 AS (SELECT *, list_filter(regexp_split_to_array(CASE WHEN contains(folded, ',') THEN split_part(regexp_replace(folded, '^[^,]*,', ''), ',', 1) || ' ' || split_part(folded, ',', 1) ELSE folded END, ' +'), lambda w: w <> '') AS w FROM n1),
n AS (SELECT *, array_to_string(list_sort(w), ' ') AS bag FROM n2)
"""
D = "d AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM pair_decisions WHERE decision IS NOT NULL AND a <> b)"
K = f"""
{N}, {D}, k AS (SELECT d.a, d.b, CASE WHEN len(x.w) = 0 OR len(y.w) = 0 THEN NULL WHEN x.w = y.w THEN 'same' WHEN list_sort(x.w) = list_sort(y.w) THEN 'order'
  WHEN x.w[-1] = y.w[-1] AND (starts_with(x.w[1], y.w[1]) OR starts_with(y.w[1], x.w[1])) AND (length(x.w[1]) = 1 OR length(y.w[1]) = 1) THEN 'initials'
  WHEN list_has_all(x.w, y.w) OR list_has_all(y.w, x.w) THEN 'part' END AS kind
FROM d JOIN n x ON x.person_id = d.a JOIN n y ON y.person_id = d.b)
"""
SQL = {
    "str14_folded": f"WITH {N} SELECT person_id, folded, bag, w[-1] AS surname FROM n",
    "str15_ladder": f"WITH {K} SELECT a, b, CASE kind WHEN 'same' THEN 1.0 WHEN 'order' THEN 0.9 WHEN 'initials' THEN 0.85 WHEN 'part' THEN 0.75 ELSE 0.0 END::DOUBLE AS score FROM k",
    "str16_agreement": f"WITH {K} SELECT a, b, kind FROM k",
    "jn6_candidates": f"WITH {N} SELECT x.person_id, (SELECT min(y.person_id) FROM n y WHERE y.unit = x.unit AND y.bag = x.bag) AS first, (SELECT count(*) FROM n y WHERE y.unit = x.unit AND y.bag = x.bag) AS crowd FROM n x WHERE x.unit IS NOT NULL AND x.bag <> '' AND (SELECT count(*) FROM n y WHERE y.unit = x.unit AND y.bag = x.bag) > 1",
    "jn13_namesakes": f"WITH {N}, a AS (SELECT DISTINCT person_id, org_id FROM affiliations WHERE person_id IS NOT NULL AND org_id IS NOT NULL) SELECT org_id, bag, count(*) AS people, min(person_id) AS first FROM a JOIN n USING (person_id) WHERE bag <> '' GROUP BY 1, 2 HAVING count(*) > 1",
    "str28_masked": rf"WITH {N}, s AS (SELECT doc_id, lower(text) AS t, w[-1] AS s FROM documents JOIN n ON person_id = lead_pid WHERE text IS NOT NULL AND length(w[-1]) > 3) SELECT doc_id, md5(regexp_replace(t, '(^|[^\p{{L}}\p{{N}}_])' || s || '($|[^\p{{L}}\p{{N}}_])', '\1[person]\2', 'g')) AS digest FROM s",
}
