"""Co-authorship, organisations, coverage, and the consolidation of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexatlas.sources import Workspace, table

#: Texts with more authors give no pair, and are counted as large.
MOST_AUTHORS, SEEDS, RINGS, DEEPEST, ROUNDS = 25, 3, 3, 32, 60
OPEN = 1 << 30


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (tid, pid)."""
    return table(spark, sf_dir, "authorships").where("tid IS NOT NULL AND pid IS NOT NULL").select("tid", "pid").distinct()


def pairs(df: DataFrame, group: str, item: str, most: int = MOST_AUTHORS) -> DataFrame:
    """(a, b, n), a < b: in how many groups two items meet. Groups of more than `most` distinct items give no pair; sizes are counted before any group is gathered."""
    ok = df.groupBy(group).count().where(f"count BETWEEN 2 AND {most}").select(group)
    sets = df.join(ok, group, "left_semi").groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("s"))
    each = sets.select(F.posexplode("s").alias("i", "a"), "s").select("a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("b"))
    return each.groupBy("a", "b").agg(F.count("*").alias("n"))


def both_ways(p: DataFrame) -> DataFrame:
    return p.select("a", "b", "n").union(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of edges (a, b), root being the smallest id it reaches. Alternates large and small stars, each a written table, until nothing moves."""
    space = Workspace(edges.sparkSession, "components")
    e = space.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen, now = None, mark(e)
    for _ in range(ROUNDS):
        if seen == now:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = space.written(star.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        space.drop(e)
        e, seen, now = after, now, mark(after)
    else:
        raise RuntimeError("components aren't done after the last round")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()


def gr1_coauthors(spark, sf_dir):
    return pairs(signed(spark, sf_dir), "tid", "pid").where("n >= 2")


def gr1_large(spark, sf_dir):
    """Per person: texts, those with too many authors, and authors outside the tables on the others."""
    a = table(spark, sf_dir, "authorships").where("tid IS NOT NULL")
    size = a.groupBy("tid").agg(F.count_distinct("pid").alias("inside"), F.max("position").alias("total"))
    x = signed(spark, sf_dir).join(size, "tid")
    large = F.col("inside") > MOST_AUTHORS
    return x.groupBy("pid").agg(F.count("*").alias("texts"), F.sum(large.cast("int")).alias("large"), F.sum(F.when(~large, F.greatest(F.col("total") - F.col("inside"), F.lit(0)))).alias("outside"))


def gr4_strongest(spark, sf_dir):
    """The five strongest co-authors of each person; of those as strong the first by id."""
    w = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    return both_ways(pairs(signed(spark, sf_dir), "tid", "pid")).withColumn("place", F.row_number().over(w)).where("place <= 5")


def rings(edges: DataFrame, seeds: DataFrame, depth: int = RINGS) -> DataFrame:
    """(id, ring, paths, weight) of the nodes around seeds (id): each in the first ring that reaches it, by so many edges of so much weight from the ring before."""
    space = Workspace(edges.sparkSession, "rings")
    edges = space.written(both_ways(edges))
    seen = space.written(seeds.select("id", F.lit(0).alias("ring"), F.lit(0).cast("long").alias("paths"), F.lit(0).cast("long").alias("weight")))
    for ring in range(1, depth + 1):
        last = seen.where(F.col("ring") == ring - 1).select(F.col("id").alias("a"))
        new = edges.join(last, "a").groupBy(F.col("b").alias("id")).agg(F.count("*").alias("paths"), F.sum("n").alias("weight")).join(seen.select("id"), "id", "left_anti")
        seen = space.written(seen.unionByName(new.withColumn("ring", F.lit(ring))))
    return seen


def gr3_rings(spark, sf_dir):
    """Rings around the people with most texts."""
    s = signed(spark, sf_dir)
    seeds = s.groupBy(F.col("pid").alias("id")).count().orderBy("count", "id").limit(SEEDS).select("id")
    return rings(pairs(s, "tid", "pid"), seeds)


def gr2_organisations(spark, sf_dir):
    """Texts that two organisations sign together."""
    o = table(spark, sf_dir, "authorships").where("tid IS NOT NULL").select("tid", F.explode("orgs").alias("org")).where("org IS NOT NULL").distinct()
    return pairs(o, "tid", "org").where("n >= 2")


def ancestors(orgs: DataFrame) -> DataFrame:
    """(org_id, ancestor) through any number of parents; an organisation isn't its own ancestor."""
    space = Workspace(orgs.sparkSession, "ancestors")
    up = space.written(orgs.select("org_id", F.explode("parents").alias("parent")).where("parent IS NOT NULL").distinct())
    all_ = space.written(up.select("org_id", F.col("parent").alias("ancestor")))
    step = all_
    for _ in range(DEEPEST):
        step = space.written(step.join(up.toDF("ancestor", "above"), "ancestor").select("org_id", F.col("above").alias("ancestor")).distinct().join(all_, ["org_id", "ancestor"], "left_anti"))
        if step.isEmpty():
            return all_.where("org_id <> ancestor")
        all_ = space.written(all_.unionByName(step))
    raise RuntimeError("organisations are nested too deeply")


def gr5_ancestors(spark, sf_dir):
    return ancestors(table(spark, sf_dir, "organisations"))


def gr5_members(spark, sf_dir):
    """People of each organisation and of those above it, ever and now."""
    a = table(spark, sf_dir, "affiliations").where("person_id IS NOT NULL AND org_id IS NOT NULL").select("person_id", "org_id", (F.col("end_year").isNull() | (F.col("end_year") > 2100)).alias("now"))
    up = ancestors(table(spark, sf_dir, "organisations"))
    lifted = a.join(up, "org_id").select("person_id", F.col("ancestor").alias("org_id"), "now").union(a.select("person_id", "org_id", "now"))
    one = lifted.groupBy("org_id", "person_id").agg(F.max(F.col("now").cast("int")).alias("now"))
    return one.groupBy("org_id").agg(F.count("*").alias("ever"), F.sum("now").alias("now"))


def gr9_coverage(spark, sf_dir):
    """People by how well their texts cover them: good, thin, without content, or without texts."""
    people = table(spark, sf_dir, "persons").select(F.col("person_id").alias("pid")).distinct()
    d = table(spark, sf_dir, "documents").groupBy(F.col("text_id").alias("tid")).agg(F.max((F.length("text") > 200).cast("int")).alias("good"))
    own = signed(spark, sf_dir).join(d, "tid").groupBy("pid").agg(F.count("*").alias("texts"), F.sum(F.coalesce("good", F.lit(0))).alias("good"))
    state = F.when(F.col("texts").isNull(), "no_data").when(F.col("good") == 0, "failed").when(F.col("good") < 3, "thin").otherwise("good")
    return people.join(own, "pid", "left").groupBy(state.alias("state")).agg(F.count("*").alias("people"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"))


def gr11_years(spark, sf_dir):
    """Per person: texts, first and last year, and whether they are none, thin or good."""
    d = table(spark, sf_dir, "documents").select(F.col("text_id").alias("tid"), "year", F.coalesce(F.length("text") > 0, F.lit(False)).alias("content"))
    x = signed(spark, sf_dir).join(d, "tid").groupBy("pid").agg(F.count("*").alias("texts"), F.sum(F.col("content").cast("int")).alias("content"), F.min("year").alias("first"), F.max("year").alias("last"))
    return x.withColumn("class", F.when((F.col("texts") < 3) | (F.col("content") == 0), "thin").otherwise("good"))


def gr10_proposal(spark, sf_dir):
    """People who sign at least twice for an organisation, with their years."""
    a = table(spark, sf_dir, "authorships").where("pid IS NOT NULL").select("tid", "pid", F.explode("orgs").alias("org")).distinct()
    d = table(spark, sf_dir, "documents").select(F.col("text_id").alias("tid"), "year")
    return a.join(d, "tid").groupBy("org", "pid").agg(F.count("*").alias("texts"), F.min("year").alias("first"), F.max("year").alias("last")).where("texts >= 2")


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, decision), a < b: the latest decision of each pair."""
    d = table(spark, sf_dir, "pair_decisions").where("decision IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lower(F.trim("decision")).alias("decision"), "decided_at")
    return d.groupBy("a", "b").agg(F.max(F.struct("decided_at", "decision")).alias("x")).select("a", "b", "x.decision")


def win4_decisions(spark, sf_dir):
    return decided(spark, sf_dir)


def er5_components(spark, sf_dir):
    return components(decided(spark, sf_dir).where("decision = 'merge'"))


def er4_works(spark, sf_dir):
    """One document for each text: of documents with the same text, by version, then length, then id. Compared by a digest."""
    d = table(spark, sf_dir, "documents").where("length(trim(text)) > 0").select("doc_id", F.sha2("text", 256).alias("work"), F.when(F.col("doc_type") == "abstract", 1).otherwise(2).alias("rank"))
    kept = d.groupBy("work").agg(F.min(F.struct("rank", "doc_id")).alias("x"), F.count("*").alias("copies"))
    return d.join(kept, "work").select("doc_id", F.col("x.doc_id").alias("kept"), "copies")


def er3_moved(spark, sf_dir):
    """Authorships moved to the kept document of each text; repeats go."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text_id")
    m = er4_works(spark, sf_dir).join(d, "doc_id").join(d.toDF("kept", "to"), "kept").select(F.col("text_id").alias("tid"), "to")
    return signed(spark, sf_dir).join(m, "tid").select(F.col("to").alias("tid"), "pid").distinct()


def er7_facts(spark, sf_dir):
    """What is known of each person over all merged records: names, units, and years."""
    r = components(decided(spark, sf_dir).where("decision = 'merge'"))
    p = table(spark, sf_dir, "persons").join(r.toDF("person_id", "root"), "person_id", "left").withColumn("root", F.coalesce("root", "person_id"))
    return p.groupBy("root").agg(F.count_distinct("person").alias("names"), F.count_distinct("unit").alias("units"), F.count_distinct("person_id").alias("records"), F.date_format(F.min("retrieved_at"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("retrieved_at"), "yyyy-MM-dd").alias("last"))


def er8_evidence(spark, sf_dir):
    """Points for two records being one: texts signed together speak against, one unit, one field and organisations in common for it. A logistic of the sum."""
    p = table(spark, sf_dir, "persons").groupBy("person_id").agg(F.max("unit").alias("unit"), F.max("field").alias("field"))
    c = decided(spark, sf_dir).select("a", "b")
    c = c.join(p.toDF("a", "ua", "fa"), "a", "left").join(p.toDF("b", "ub", "fb"), "b", "left")
    together = pairs(signed(spark, sf_dir), "tid", "pid").select("a", "b", "n")
    org = table(spark, sf_dir, "affiliations").where("person_id IS NOT NULL").select("person_id", "org_id").distinct()
    shared = c.select("a", "b").join(org.toDF("a", "org"), "a").join(org.toDF("b", "org"), ["b", "org"]).groupBy("a", "b").agg(F.count("*").alias("orgs"))
    c = c.join(together, ["a", "b"], "left").join(shared, ["a", "b"], "left").fillna(0, ["n", "orgs"])
    same = lambda x, y: F.when(F.col(x) == F.col(y), 1.0).otherwise(0.0)
    points = 2 * same("ua", "ub") + same("fa", "fb") + F.least(F.col("orgs"), F.lit(2)) - F.when(F.col("n") > 0, 3.0).otherwise(0.0)
    return c.select("a", "b", points.alias("points"), F.round(1 / (1 + F.exp(2 - points)), 6).alias("score"))


def er11_kept(spark, sf_dir):
    """Of each group of merged records the one kept: that of most texts, then by id."""
    r = components(decided(spark, sf_dir).where("decision = 'merge'"))
    n = signed(spark, sf_dir).groupBy(F.col("pid").alias("id")).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("k"), "id"))
    return r.join(n, "id", "left").groupBy("root").agg(best.alias("x"), F.count("*").alias("records")).select("root", F.col("x.id").alias("kept"), "records")


def win2_current(spark, sf_dir):
    """The affiliation that holds now: open ends before all, then the latest end, the latest start, and the organisation."""
    a = table(spark, sf_dir, "affiliations").where("person_id IS NOT NULL AND org_id IS NOT NULL")
    best = F.max(F.struct(F.coalesce("end_year", F.lit(OPEN)).alias("e"), F.coalesce("start_year", F.lit(-OPEN)).alias("s"), "org_id"))
    return a.groupBy("person_id").agg(best.alias("x")).select("person_id", "x.org_id", F.when(F.col("x.e") < OPEN, F.col("x.e")).alias("end_year"))


def win7_balanced(spark, sf_dir):
    """The first 20 people of each cohort by id. Spark keeps 20 of each task before the shuffle."""
    p = table(spark, sf_dir, "persons").where("cohort_id IS NOT NULL").select("cohort_id", "person_id").distinct()
    return p.withColumn("place", F.row_number().over(Window.partitionBy("cohort_id").orderBy("person_id"))).where("place <= 20")


def win9_islands(spark, sf_dir):
    """Runs of years in which a person signs texts. A person has as many rows as years."""
    d = table(spark, sf_dir, "documents").where("year IS NOT NULL").select(F.col("text_id").alias("tid"), "year")
    y = signed(spark, sf_dir).join(d, "tid").select("pid", "year").distinct()
    run = y.withColumn("run", F.col("year") - F.row_number().over(Window.partitionBy("pid").orderBy("year")))
    return run.groupBy("pid", "run").agg(F.min("year").alias("first"), F.max("year").alias("last")).drop("run")


def jn3_effective(spark, sf_dir):
    """Units after decisions: a record merged into another takes the unit of the one kept where its own is missing."""
    r = components(decided(spark, sf_dir).where("decision = 'merge'"))
    p = table(spark, sf_dir, "persons").groupBy("person_id").agg(F.max("unit").alias("unit"))
    whole = p.join(r.toDF("person_id", "root"), "person_id").groupBy("root").agg(F.min("unit").alias("group_unit"))
    x = p.join(r.toDF("person_id", "root"), "person_id", "left").join(whole, "root", "left")
    return x.select("person_id", F.coalesce("unit", "group_unit").alias("unit"))


def jn4_signed_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(signed(spark, sf_dir).select(F.col("tid").alias("text_id")), "text_id", "left_semi").select("doc_id")


def jn5_unplaced(spark, sf_dir):
    """People without any affiliation."""
    a = table(spark, sf_dir, "affiliations").where("person_id IS NOT NULL").select("person_id")
    return table(spark, sf_dir, "persons").select("person_id").distinct().join(a, "person_id", "left_anti")


def jn9_at_the_time(spark, sf_dir):
    """Texts of each organisation, by where their authors were in the year of the text."""
    d = table(spark, sf_dir, "documents").where("year IS NOT NULL").select(F.col("text_id").alias("tid"), "year")
    a = table(spark, sf_dir, "affiliations").where("person_id IS NOT NULL AND org_id IS NOT NULL").select(F.col("person_id").alias("pid"), "org_id", F.coalesce("start_year", F.lit(0)).alias("s"), F.coalesce("end_year", F.lit(OPEN)).alias("e")).distinct()
    # texts of one person and year are counted at once, so a hot person meets its affiliations a few times only
    x = signed(spark, sf_dir).join(d, "tid")
    at = x.select("pid", "year").distinct().join(a, "pid").where("year BETWEEN s AND e").select("pid", "year", "org_id").distinct()
    return x.join(at, ["pid", "year"]).select("org_id", "tid").distinct().groupBy("org_id").agg(F.count("*").alias("texts"))


def jn15_shared(spark, sf_dir):
    """Texts that the two people with most texts both signed."""
    s = signed(spark, sf_dir)
    two = s.groupBy("pid").count().orderBy(F.desc("count"), "pid").limit(2).select("pid")
    return s.join(two, "pid", "left_semi").groupBy("tid").agg(F.count("*").alias("k")).where("k = 2").select("tid")


def q21_overview(spark, sf_dir):
    """How many rows and keys there are."""
    of = lambda name, key: table(spark, sf_dir, name).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys")).select(F.lit(name).alias("name"), "rows", "keys")
    return of("documents", "doc_id").union(of("persons", "person_id")).union(of("organisations", "org_id")).union(of("authorships", "tid")).union(of("vocabulary", "term"))


def q10_focus(spark, sf_dir):
    """Texts of the people of one organisation."""
    m = table(spark, sf_dir, "affiliations").where("org_id = 'O00001' AND person_id IS NOT NULL").select(F.col("person_id").alias("pid")).distinct()
    return signed(spark, sf_dir).join(m, "pid").groupBy("tid").agg(F.count("*").alias("members"))


QUERIES = {f.__name__: f for f in (
    gr1_coauthors, gr1_large, gr2_organisations, gr3_rings, gr4_strongest, gr5_ancestors, gr5_members, gr9_coverage, gr10_proposal, gr11_years, win2_current, win4_decisions, win7_balanced, win9_islands,
    er3_moved, er4_works, er5_components, er7_facts, er8_evidence, er11_kept, jn3_effective, jn4_signed_texts, jn5_unplaced, jn9_at_the_time, jn15_shared, q10_focus, q21_overview,
)}
S = f"""
s AS (SELECT DISTINCT tid, pid FROM authorships WHERE tid IS NOT NULL AND pid IS NOT NULL),
z AS (SELECT tid, count(*) AS size FROM s GROUP BY 1),
p AS (SELECT x.pid AS a, y.pid AS b, count(*) AS n FROM s x JOIN s y ON x.tid = y.tid AND x.pid < y.pid JOIN z ON z.tid = x.tid AND size <= {MOST_AUTHORS} GROUP BY 1, 2),
pp AS (SELECT a, b, n FROM p UNION ALL SELECT b, a, n FROM p)
"""
D = """
d AS (SELECT least(a, b) AS a, greatest(a, b) AS b, (max({'at': decided_at, 'd': lower(trim(decision, ' '))})).d AS decision FROM pair_decisions WHERE decision IS NOT NULL AND a <> b GROUP BY 1, 2),
me AS (SELECT a, b FROM d WHERE decision = 'merge' UNION SELECT b, a FROM d WHERE decision = 'merge')
"""
R = "RECURSIVE " + D + ", r0 AS (SELECT a AS id, a AS other FROM me UNION SELECT r0.id, me.b FROM r0 JOIN me ON r0.other = me.a), r AS (SELECT id, min(other) AS root FROM r0 GROUP BY 1)"
UP = "RECURSIVE up AS (SELECT DISTINCT org_id, unnest(parents) AS ancestor FROM organisations UNION SELECT up.org_id, o.parent FROM up JOIN (SELECT org_id, unnest(parents) AS parent FROM organisations) o ON o.org_id = up.ancestor)"
WORKS = "x AS (SELECT doc_id, sha256(text) AS work, CASE WHEN doc_type = 'abstract' THEN 1 ELSE 2 END AS rank FROM documents WHERE length(trim(text, ' ')) > 0), y AS (SELECT work, (min({'rank': rank, 'doc_id': doc_id})).doc_id AS kept, count(*) AS copies FROM x GROUP BY 1), w AS (SELECT doc_id, kept, copies FROM x JOIN y USING (work))"
P = "u AS (SELECT person_id, max(unit) AS unit, max(field) AS field FROM persons GROUP BY 1)"
SQL = {
    "gr1_coauthors": f"WITH {S} SELECT * FROM p WHERE n >= 2",
    "gr1_large": f"WITH {S}, t AS (SELECT tid, count(DISTINCT pid) AS inside, max(position) AS total FROM authorships WHERE tid IS NOT NULL GROUP BY 1) SELECT pid, count(*) AS texts, CAST(sum((inside > {MOST_AUTHORS})::INT) AS BIGINT) AS large, CAST(sum(CASE WHEN inside <= {MOST_AUTHORS} THEN greatest(total - inside, 0) END) AS BIGINT) AS outside FROM s JOIN t USING (tid) GROUP BY 1",
    "gr2_organisations": f"WITH o AS (SELECT DISTINCT tid, unnest(orgs) AS org FROM authorships WHERE tid IS NOT NULL), q AS (SELECT * FROM o WHERE org IS NOT NULL), z AS (SELECT tid FROM q GROUP BY 1 HAVING count(*) <= {MOST_AUTHORS}) SELECT x.org AS a, y.org AS b, count(*) AS n FROM q x JOIN q y ON x.tid = y.tid AND x.org < y.org JOIN z ON z.tid = x.tid GROUP BY 1, 2 HAVING count(*) >= 2",
    "gr3_rings": f"""WITH {S}, s0 AS (SELECT pid AS id FROM s GROUP BY 1 ORDER BY count(*), pid LIMIT {SEEDS}),
r1 AS (SELECT b AS id, count(*) AS paths, sum(n) AS weight FROM pp WHERE a IN (FROM s0) AND b NOT IN (FROM s0) GROUP BY 1),
k1 AS (SELECT id FROM s0 UNION ALL SELECT id FROM r1), r2 AS (SELECT b AS id, count(*) AS paths, sum(n) AS weight FROM pp WHERE a IN (SELECT id FROM r1) AND b NOT IN (FROM k1) GROUP BY 1),
k2 AS (SELECT id FROM k1 UNION ALL SELECT id FROM r2), r3 AS (SELECT b AS id, count(*) AS paths, sum(n) AS weight FROM pp WHERE a IN (SELECT id FROM r2) AND b NOT IN (FROM k2) GROUP BY 1)
SELECT id, 0 AS ring, 0::BIGINT AS paths, 0::BIGINT AS weight FROM s0 UNION ALL SELECT id, 1, paths, weight::BIGINT FROM r1 UNION ALL SELECT id, 2, paths, weight::BIGINT FROM r2 UNION ALL SELECT id, 3, paths, weight::BIGINT FROM r3""",
    "gr4_strongest": f"WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM pp) SELECT a, b, n, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5",
    "gr5_ancestors": f"WITH {UP} SELECT DISTINCT org_id, ancestor FROM up WHERE ancestor IS NOT NULL AND org_id <> ancestor",
    "gr5_members": f"WITH {UP}, c AS (SELECT org_id, ancestor FROM up WHERE ancestor IS NOT NULL AND org_id <> ancestor UNION SELECT DISTINCT org_id, org_id FROM affiliations WHERE org_id IS NOT NULL), m AS (SELECT ancestor AS org_id, person_id, max((end_year IS NULL OR end_year > 2100)::INT) AS now FROM affiliations JOIN c USING (org_id) WHERE person_id IS NOT NULL GROUP BY 1, 2) SELECT org_id, count(*) AS ever, CAST(sum(now) AS BIGINT) AS now FROM m GROUP BY 1",
    "gr9_coverage": f"WITH {S}, d AS (SELECT text_id AS tid, max((length(text) > 200)::INT) AS good FROM documents GROUP BY 1), o AS (SELECT pid, count(*) AS texts, sum(coalesce(good, 0)) AS good FROM s JOIN d USING (tid) GROUP BY 1) SELECT CASE WHEN texts IS NULL THEN 'no_data' WHEN good = 0 THEN 'failed' WHEN good < 3 THEN 'thin' ELSE 'good' END AS state, count(*) AS people, CAST(coalesce(sum(texts), 0) AS BIGINT) AS texts FROM (SELECT DISTINCT person_id AS pid FROM persons) LEFT JOIN o USING (pid) GROUP BY 1",
    "gr10_proposal": "WITH a AS (SELECT DISTINCT tid, pid, unnest(orgs) AS org FROM authorships WHERE pid IS NOT NULL) SELECT org, pid, count(*) AS texts, min(year) AS first, max(year) AS last FROM a JOIN documents d ON d.text_id = a.tid GROUP BY 1, 2 HAVING count(*) >= 2",
    "gr11_years": f"WITH {S} SELECT pid, count(*) AS texts, CAST(sum(coalesce(length(text) > 0, false)::INT) AS BIGINT) AS content, min(year) AS first, max(year) AS last, CASE WHEN count(*) < 3 OR sum(coalesce(length(text) > 0, false)::INT) = 0 THEN 'thin' ELSE 'good' END AS class FROM s JOIN documents d ON d.text_id = s.tid GROUP BY 1",
    "win2_current": f"WITH a AS (SELECT person_id, max({{'e': coalesce(end_year, {OPEN}), 's': coalesce(start_year, -{OPEN}), 'o': org_id}}) AS x FROM affiliations WHERE person_id IS NOT NULL AND org_id IS NOT NULL GROUP BY 1) SELECT person_id, x.o AS org_id, CASE WHEN x.e < {OPEN} THEN x.e END AS end_year FROM a",
    "win4_decisions": f"WITH {D} SELECT a, b, decision FROM d",
    "win7_balanced": "WITH p AS (SELECT DISTINCT cohort_id, person_id FROM persons WHERE cohort_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY cohort_id ORDER BY person_id) AS place FROM p) SELECT cohort_id, person_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 20",
    "win9_islands": f"WITH {S}, y AS (SELECT DISTINCT pid, year FROM s JOIN documents d ON d.text_id = s.tid WHERE year IS NOT NULL), g AS (SELECT *, year - row_number() OVER (PARTITION BY pid ORDER BY year) AS run FROM y) SELECT pid, min(year) AS first, max(year) AS last FROM g GROUP BY pid, run",
    "er3_moved": f"WITH {S}, {WORKS} SELECT DISTINCT k.text_id AS tid, pid FROM s JOIN documents d ON d.text_id = s.tid JOIN w ON w.doc_id = d.doc_id JOIN documents k ON k.doc_id = w.kept",
    "er4_works": f"WITH {WORKS} SELECT * FROM w",
    "er5_components": f"WITH {R} SELECT id, root FROM r",
    "er7_facts": f"WITH {R} SELECT coalesce(root, person_id) AS root, count(DISTINCT person) AS names, count(DISTINCT unit) AS units, count(DISTINCT person_id) AS records, strftime(min(retrieved_at), '%Y-%m-%d') AS first, strftime(max(retrieved_at), '%Y-%m-%d') AS last FROM persons LEFT JOIN r ON r.id = person_id GROUP BY 1",
    "er8_evidence": f"""WITH {S}, {D}, {P}, o AS (SELECT DISTINCT person_id, org_id FROM affiliations WHERE person_id IS NOT NULL),
sh AS (SELECT d.a, d.b, count(*) AS orgs FROM d JOIN o x ON x.person_id = d.a JOIN o y ON y.person_id = d.b AND x.org_id = y.org_id GROUP BY 1, 2),
e AS (SELECT d.a, d.b, 2 * (coalesce(x.unit = y.unit, false))::INT + (coalesce(x.field = y.field, false))::INT + least(coalesce(orgs, 0), 2) - CASE WHEN p.n > 0 THEN 3 ELSE 0 END AS k
FROM d LEFT JOIN u x ON x.person_id = d.a LEFT JOIN u y ON y.person_id = d.b LEFT JOIN p ON p.a = d.a AND p.b = d.b LEFT JOIN sh ON sh.a = d.a AND sh.b = d.b)
SELECT a, b, k::DOUBLE AS points, round(1 / (1 + exp(2 - k)), 6) AS score FROM e""",
    "er11_kept": f"WITH {R}, n AS (SELECT pid, count(DISTINCT tid) AS n FROM authorships WHERE tid IS NOT NULL GROUP BY 1) SELECT root, (min({{'k': -coalesce(n, 0), 'id': id}})).id AS kept, count(*) AS records FROM r LEFT JOIN n ON n.pid = id GROUP BY 1",
    "jn3_effective": f"WITH {R}, {P}, g AS (SELECT root, min(unit) AS gu FROM r JOIN u ON u.person_id = r.id GROUP BY 1) SELECT person_id, coalesce(unit, gu) AS unit FROM u LEFT JOIN r ON r.id = person_id LEFT JOIN g USING (root)",
    "jn4_signed_texts": f"WITH {S} SELECT doc_id FROM documents WHERE text_id IN (SELECT tid FROM s)",
    "jn5_unplaced": "SELECT DISTINCT person_id FROM persons WHERE person_id NOT IN (SELECT person_id FROM affiliations WHERE person_id IS NOT NULL)",
    "jn9_at_the_time": f"WITH {S} SELECT org_id, count(DISTINCT tid) AS texts FROM s JOIN documents d ON d.text_id = s.tid JOIN affiliations a ON a.person_id = s.pid AND year BETWEEN coalesce(start_year, 0) AND coalesce(end_year, {OPEN}) WHERE org_id IS NOT NULL GROUP BY 1",
    "jn15_shared": f"WITH {S}, two AS (SELECT pid FROM s GROUP BY 1 ORDER BY count(*) DESC, pid LIMIT 2) SELECT tid FROM s WHERE pid IN (FROM two) GROUP BY 1 HAVING count(*) = 2",
    "q10_focus": f"WITH {S} SELECT tid, count(*) AS members FROM s WHERE pid IN (SELECT person_id FROM affiliations WHERE org_id = 'O00001') GROUP BY 1",
    "q21_overview": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, count(DISTINCT {k}) AS keys FROM {n}" for n, k in (("documents", "doc_id"), ("persons", "person_id"), ("organisations", "org_id"), ("authorships", "tid"), ("vocabulary", "term"))),
}
