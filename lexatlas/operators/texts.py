"""Scans, filters and scalar text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.functions.text import LETTERS, counted_form, length_bonus, singular, words
from lexatlas.sources import table

SPACE = r"[ \t\n\r\f]+"
#: Words that mark a language.
MARKERS = {"en": "the of and with was", "fr": "le les des dans est", "es": "el los las con una", "de": "der die und das ist", "pt": "os das uma com nos", "it": "il gli della con che"}
RANKS = {"report": 1, "abstract": 2, "glossary": 3, "comment": 4}
BLOCKED = ("sensor", "coral")
NOW, RECENT_YEARS, PIECE = 2025, 10, 1000


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vocabulary").where("term IS NOT NULL")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct terms in lower case, trimmed; blank ones are left out."""
    return vocabulary(spark, sf_dir).select(F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct()


def src2_violations(spark, sf_dir):
    """Rows that break what a table promises: keys missing, keys repeated, counts of characters that are wrong."""
    d = docs(spark, sf_dir)
    checks = [("doc_id missing", d.where("doc_id IS NULL")), ("text_id missing", d.where("text_id IS NULL")), ("n_chars wrong", d.where(~F.length("text").eqNullSafe(F.col("n_chars")))), ("doc_id repeated", d.groupBy("doc_id").count().where("count > 1"))]
    out = [x.agg(F.count("*").alias("rows")).select(F.lit(name).alias("violation"), "rows") for name, x in checks]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def src6_recent(spark, sf_dir):
    """Texts of the last years, and those without a year."""
    return docs(spark, sf_dir).where(F.col("year").isNull() | (F.col("year") >= NOW - RECENT_YEARS + 1)).select("doc_id", "year")


def src7_roster(spark, sf_dir):
    """One row for each person: of every attribute the first value that is not empty, in order of collection."""
    first = lambda c: F.min(F.when(F.col(c) != "", F.struct("retrieved_at", F.col(c).alias("v"))))["v"].alias(c)
    return table(spark, sf_dir, "persons").groupBy("person_id").agg(first("person"), first("unit"), first("field"), F.count("*").alias("records"))


def src12_current_runs(spark, sf_dir):
    """The figures of each pair in its latest run."""
    m = table(spark, sf_dir, "metrics").where("cosine IS NOT NULL AND NOT isnan(cosine)")
    return m.groupBy("a", "b").agg(F.max(F.struct("run_id", "cosine")).alias("x")).select("a", "b", "x.run_id", "x.cosine")


def str1_tokens(spark, sf_dir):
    t = F.filter(F.split(F.lower("text"), SPACE), lambda x: x != "")
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.size(t).alias("tokens"))


def str2_counted(spark, sf_dir):
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", counted_form("text").alias("form"))


def str4_word_counts(spark, sf_dir):
    """How often each word occurs, and in how many texts. Counted per text first."""
    w = docs(spark, sf_dir).select("doc_id", F.explode(words(F.lower("text"), LETTERS)).alias("word"))
    return w.groupBy("word", "doc_id").count().groupBy("word").agg(F.sum("count").alias("occurrences"), F.count("*").alias("texts"))


def str6_length_bonus(spark, sf_dir):
    n = F.size(F.split(F.trim("term"), " +"))
    return vocabulary(spark, sf_dir).where("score_total IS NOT NULL").select("cohort_id", "term", F.round(length_bonus(F.col("score_total"), n), 4).alias("score"))


def str7_singular(spark, sf_dir):
    key = F.array_join(F.transform(F.split("term", " "), singular), " ")
    return terms(spark, sf_dir).select("term", key.alias("key"))


def str9_malformed(spark, sf_dir):
    bad = F.col("term").rlike(r"https?:|www\.|\.(com|org|net)\b") | F.col("term").rlike(r"[^\p{L}\p{N} '’.,/()&+-]")
    return terms(spark, sf_dir).select("term", bad.alias("malformed"))


def str10_blocked(spark, sf_dir):
    """Terms that are blocked or hold a blocked word."""
    return terms(spark, sf_dir).where(F.arrays_overlap(F.split("term", " "), F.array(*map(F.lit, BLOCKED))))


def str11_markers(spark, sf_dir):
    """The language whose marker words are the most in a text; und where none is or two are as many."""
    w = words(F.lower("text"))
    hits = lambda v: F.size(F.filter(w, lambda x: x.isin(v.split())))
    n = {k: hits(v) for k, v in MARKERS.items()}
    d = docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", *(v.alias(k) for k, v in n.items()))
    top = F.greatest(*MARKERS)
    ties = sum((F.col(k) == top).cast("int") for k in MARKERS)
    best = F.coalesce(*(F.when(F.col(k) == top, F.lit(k)) for k in MARKERS))
    return d.select("doc_id", F.when((top == 0) | (ties > 1), "und").otherwise(best).alias("language"))


def str12_paragraphs(spark, sf_dir):
    p = docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("position", "paragraph"))
    return p.where(F.trim("paragraph") != "").select("doc_id", "position", F.length("paragraph").alias("chars"))


def str13_pieces(spark, sf_dir):
    """Texts in pieces of at most PIECE characters."""
    d = docs(spark, sf_dir).where("length(text) > 0")
    p = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.expr(f"cast((length(text) - 1) div {PIECE} AS int)"))).alias("piece"))
    return p.select("doc_id", "piece", F.md5(F.substring("text", F.col("piece") * PIECE + 1, F.lit(PIECE))).alias("digest"))


def str17_titles(spark, sf_dir):
    """Titles without case, accents and signs, and how many rows share one."""
    key = F.trim(F.regexp_replace(F.translate(F.lower("content"), "àâäáãåçéèêëíìîïñóòôöõúùûü", "aaaaaaceeeeiiiinooooouuuu"), r"[^\p{L}\p{N}]+", " "))
    return table(spark, sf_dir, "parts").where("part = 'title' AND content IS NOT NULL").groupBy(key.alias("title")).agg(F.count("*").alias("parts"))


def str18_versions(spark, sf_dir):
    rank = F.coalesce(*(F.when(F.lower("doc_type") == k, v) for k, v in RANKS.items()), F.lit(9))
    return docs(spark, sf_dir).select("doc_id", rank.alias("rank"))


def str20_hygiene(spark, sf_dir):
    """Contents without tags and control characters, with single spaces."""
    c = F.regexp_replace(F.regexp_replace("content", r"<[^<>]+>", " "), r"[\x00-\x1f\x7f ]+", " ")
    return table(spark, sf_dir, "parts").where("content IS NOT NULL").select("part_id", F.md5(F.trim(c)).alias("digest"))


def str24_chronological(spark, sf_dir):
    """Texts that name a century."""
    return docs(spark, sf_dir).where(F.lower("text").rlike(r"(th century|si[eè]cle|siglo|jahrhundert|s[eé]culo|secolo)")).select("doc_id")


def str29_rendered(spark, sf_dir):
    """Of each text and part the row that comes first by provider, then by date and content."""
    p = table(spark, sf_dir, "parts").where("content <> ''")
    return p.groupBy("text_id", "part").agg(F.min(F.struct(F.coalesce("provider", F.lit("~")).alias("provider"), "retrieved_at", "content")).alias("x")).select("text_id", "part", "x.provider", F.md5("x.content").alias("digest"))


def flt1_texts(spark, sf_dir):
    d = docs(spark, sf_dir).where(F.col("lang").isin("en", "fr") & F.col("year").between(2005, 2020) & F.lower("text").contains("estua"))
    return d.select("doc_id", "lang", "year")


def flt2_people(spark, sf_dir):
    """People by field and source, as facets."""
    return table(spark, sf_dir, "persons").groupBy("field", "source").agg(F.count_distinct("person_id").alias("people"), F.count(F.when(F.lower("person").contains("an"), 1)).alias("matching"))


def win5_page(spark, sf_dir):
    """The second page of texts by year, latest first, without year last."""
    return docs(spark, sf_dir).orderBy(F.desc_nulls_last("year"), "text_id", "doc_id").offset(50).limit(50).select("doc_id", "text_id", "year")


def scl7_digests(spark, sf_dir):
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256"))


def scl9_sets(spark, sf_dir):
    """Organisations of a text's authors that its first author doesn't have."""
    a = table(spark, sf_dir, "authorships").where("tid IS NOT NULL AND orgs IS NOT NULL")
    first = a.where("position = 1").select("tid", F.explode("orgs").alias("org")).distinct()
    return a.select("tid", F.explode("orgs").alias("org")).distinct().join(first, ["tid", "org"], "left_anti").groupBy("tid").agg(F.count("*").alias("others"))


def scl10_ids(spark, sf_dir):
    return table(spark, sf_dir, "organisations").select("org_id", F.explode("ids").alias("scheme", "id"))


def scl11_places(spark, sf_dir):
    return table(spark, sf_dir, "organisations").where("location IS NOT NULL").groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg("location.lat"), 6).alias("lat"), F.round(F.avg("location.lon"), 6).alias("lon"))


def scl12_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select((k % 10).alias("k"), "event_type").groupBy("k", "event_type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    src2_violations, src6_recent, src7_roster, src12_current_runs, str1_tokens, str2_counted, str4_word_counts, str6_length_bonus, str7_singular, str9_malformed, str10_blocked, str11_markers,
    str12_paragraphs, str13_pieces, str17_titles, str18_versions, str20_hygiene, str24_chronological, str29_rendered, flt1_texts, flt2_people, win5_page, scl7_digests, scl9_sets, scl10_ids, scl11_places, scl12_json,
)}
T = "t AS (SELECT DISTINCT lower(trim(term, ' ')) AS term FROM vocabulary WHERE term IS NOT NULL AND trim(term, ' ') <> '')"
_MARKED = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in v.split())}))) AS {k}" for k, v in MARKERS.items())
_TOP = f"greatest({', '.join(MARKERS)})"
SQL = {
    "src2_violations": """
SELECT 'doc_id missing' AS violation, count(*) AS rows FROM documents WHERE doc_id IS NULL
UNION ALL SELECT 'text_id missing', count(*) FROM documents WHERE text_id IS NULL
UNION ALL SELECT 'n_chars wrong', count(*) FROM documents WHERE length(text) IS DISTINCT FROM n_chars
UNION ALL SELECT 'doc_id repeated', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)""",
    "src6_recent": f"SELECT doc_id, year FROM documents WHERE year IS NULL OR year >= {NOW - RECENT_YEARS + 1}",
    "src7_roster": "SELECT person_id, " + ", ".join(f"(min(CASE WHEN {c} <> '' THEN {{'at': retrieved_at, 'v': {c}}} END)).v AS {c}" for c in ("person", "unit", "field")) + ", count(*) AS records FROM persons GROUP BY 1",
    "src12_current_runs": "WITH m AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY run_id DESC, cosine DESC) AS k FROM metrics WHERE cosine IS NOT NULL AND NOT isnan(cosine)) SELECT a, b, run_id, cosine FROM m WHERE k = 1",
    "str1_tokens": r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '')) AS INTEGER) AS tokens FROM documents WHERE text IS NOT NULL",
    "str2_counted": r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), ' ') AS form FROM documents WHERE text IS NOT NULL",
    "str4_word_counts": r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS word FROM documents) SELECT word, count(*) AS occurrences, count(DISTINCT doc_id) AS texts FROM w GROUP BY 1",
    "str6_length_bonus": "SELECT cohort_id, term, round(score_total * (1 + 2.0::DOUBLE * (len(regexp_split_to_array(trim(term, ' '), ' +')) - 1)), 4) AS score FROM vocabulary WHERE term IS NOT NULL AND score_total IS NOT NULL",
    "str7_singular": f"""WITH {T} SELECT term, array_to_string(list_transform(string_split(term, ' '), lambda w:
CASE WHEN w LIKE '%eaux' THEN left(w, length(w) - 1) WHEN w LIKE '%aux' THEN left(w, length(w) - 2) || 'l' WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y'
     WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END), ' ') AS key FROM t""",
    "str9_malformed": rf"WITH {T} SELECT term, regexp_matches(term, 'https?:|www\.|\.(com|org|net)\b') OR regexp_matches(term, '[^\p{{L}}\p{{N}} ''’.,/()&+-]') AS malformed FROM t",
    "str10_blocked": f"WITH {T} SELECT term FROM t WHERE list_has_any(string_split(term, ' '), [{', '.join(map(repr, BLOCKED))}])",
    "str11_markers": rf"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, {_MARKED} FROM d)
SELECT doc_id, CASE WHEN {_TOP} = 0 OR {' + '.join(f'({k} = {_TOP})::INT' for k in MARKERS)} > 1 THEN 'und' {' '.join(f"WHEN {k} = {_TOP} THEN '{k}'" for k in MARKERS)} END AS language FROM n""",
    "str12_paragraphs": "WITH p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS x FROM p) SELECT doc_id, CAST(i AS INTEGER) AS position, CAST(length(x) AS INTEGER) AS chars FROM q WHERE trim(x, ' ') <> ''",
    "str13_pieces": f"WITH p AS (SELECT doc_id, text, unnest(range((length(text) - 1) // {PIECE} + 1)) AS i FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(i AS INTEGER) AS piece, md5(substring(text, i * {PIECE} + 1, {PIECE})) AS digest FROM p",
    "str17_titles": r"SELECT trim(regexp_replace(translate(lower(content), 'àâäáãåçéèêëíìîïñóòôöõúùûü', 'aaaaaaceeeeiiiinooooouuuu'), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS title, count(*) AS parts FROM parts WHERE part = 'title' AND content IS NOT NULL GROUP BY 1",
    "str18_versions": "SELECT doc_id, CASE lower(doc_type) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANKS.items()) + " ELSE 9 END AS rank FROM documents",
    "str20_hygiene": r"SELECT part_id, md5(trim(regexp_replace(regexp_replace(content, '<[^<>]+>', ' ', 'g'), '[\x00-\x1f\x7f ]+', ' ', 'g'), ' ')) AS digest FROM parts WHERE content IS NOT NULL",
    "str24_chronological": "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(th century|si[eè]cle|siglo|jahrhundert|s[eé]culo|secolo)')",
    "str29_rendered": "WITH p AS (SELECT *, coalesce(provider, '~') AS q, row_number() OVER (PARTITION BY text_id, part ORDER BY coalesce(provider, '~'), retrieved_at NULLS FIRST, content) AS k FROM parts WHERE content <> '') SELECT text_id, part, q AS provider, md5(content) AS digest FROM p WHERE k = 1",
    "flt1_texts": "SELECT doc_id, lang, year FROM documents WHERE lang IN ('en', 'fr') AND year BETWEEN 2005 AND 2020 AND contains(lower(text), 'estua')",
    "flt2_people": "SELECT field, source, count(DISTINCT person_id) AS people, count(*) FILTER (contains(lower(person), 'an')) AS matching FROM persons GROUP BY 1, 2",
    "win5_page": "SELECT doc_id, text_id, year FROM documents ORDER BY year DESC NULLS LAST, text_id, doc_id LIMIT 50 OFFSET 50",
    "scl7_digests": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
    "scl9_sets": "WITH a AS (SELECT DISTINCT tid, unnest(orgs) AS org, position = 1 AS first FROM authorships WHERE tid IS NOT NULL) SELECT tid, count(DISTINCT org) AS others FROM a x WHERE org IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a y WHERE y.tid = x.tid AND y.org = x.org AND y.first) GROUP BY 1",
    "scl10_ids": "SELECT org_id, unnest(map_keys(ids)) AS scheme, unnest(map_values(ids)) AS id FROM organisations",
    "scl11_places": "SELECT country, count(*) AS n, round(avg(location.lat), 6) AS lat, round(avg(location.lon), 6) AS lon FROM organisations WHERE location IS NOT NULL GROUP BY 1",
    "scl12_json": "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
