"""Continuous periods of intervals per entity, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexatlas.sources import table

#: Open ends lie beyond every year of an int.
EVER, FIRST_YEAR, LAST_YEAR = 1 << 40, 1900, 2100


def boundaries(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, at, closed, opened, since): the boundaries at which a period opens or closes, at being inclusive starts and exclusive ends.

    Starts and ends are ranked independently. The rank of a boundary is a running count over the distinct years of its entity, so an entity
    has as many rows here as years, however many intervals it has. With the i-th end at `at`, a gap follows exactly if the i+1-th start is
    later: that is, if as many starts as ends lie at or before it. Ends are taken exclusive, so intervals that touch don't leave a gap.
    Rows without entity, start or end, and with start > end, are left out. Repeated rows change nothing.
    """
    ok = df.where(F.col(entity).isNotNull() & (F.col(start) <= F.col(end)))
    year = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("starts"), F.lit(0).alias("ends")), F.struct((F.col(end) + 1).alias("at"), F.lit(0).alias("starts"), F.lit(1).alias("ends"))))
    counts = ok.select(F.col(entity).alias("entity"), year.alias("x")).groupBy("entity", "x.at").agg(F.sum("x.starts").alias("starts"), F.sum("x.ends").alias("ends"))
    by = Window.partitionBy("entity").orderBy("at")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("entity", "at", (F.sum("starts").over(so_far) == F.sum("ends").over(so_far)).alias("closed"))
    opened = ranked.select("entity", "at", "closed", F.coalesce(F.lag("closed").over(by), F.lit(True)).alias("opened"), F.lead("at").over(by).alias("next"))
    return opened.select("*", F.last(F.when(F.col("opened"), F.col("at")), ignorenulls=True).over(so_far).alias("since"))


def periods(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, start, end) of the continuous periods, both inclusive: the start that opens one is paired with the end that closes it."""
    return boundaries(df, entity, start, end).where("closed").select("entity", F.col("since").alias("start"), (F.col("at") - 1).alias("end"))


def gaps(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, start, end) of the gaps between two periods, both inclusive."""
    return boundaries(df, entity, start, end).where("closed AND next IS NOT NULL").select("entity", F.col("at").alias("start"), (F.col("next") - 1).alias("end"))


def spans(affiliations: DataFrame) -> DataFrame:
    """(person_id, s, e) of affiliations: ends null or above 2100 are open for ever, starts null or below 1900 open backwards."""
    s, e = F.col("start_year").cast("long"), F.col("end_year").cast("long")
    return affiliations.select(
        "person_id",
        F.when(s.isNull() | (s < FIRST_YEAR), -EVER).otherwise(s).alias("s"),
        F.when(e.isNull() | (e > LAST_YEAR), EVER).otherwise(e).alias("e"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4: first and last year of each gap between two periods of a person."""
    g = gaps(spans(table(spark, sf_dir, "affiliations")), "person_id", "s", "e")
    return g.select(F.col("entity").alias("person_id"), F.col("start").cast("int").alias("gap_start"), F.col("end").cast("int").alias("gap_end"))


def p4_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4: the continuous periods of each person; null years are open."""
    p = periods(spans(table(spark, sf_dir, "affiliations")), "person_id", "s", "e")
    known = lambda c: F.when(F.abs(c) < EVER // 2, F.col(c)).cast("int")
    return p.select(F.col("entity").alias("person_id"), known("start").alias("period_start"), known("end").alias("period_end"))


SPANS = """
p AS (SELECT person_id, CASE WHEN start_year IS NULL OR start_year < 1900 THEN -1000000 ELSE start_year END AS s,
             CASE WHEN end_year IS NULL OR end_year > 2100 THEN 1000000 ELSE end_year END AS e
      FROM affiliations WHERE person_id IS NOT NULL),
q AS (SELECT DISTINCT * FROM p WHERE s <= e)
"""
QUERIES = {"p4_found": p4_found, "p4_periods": p4_periods}
SQL = {
    "p4_found": f"""
WITH {SPANS}
SELECT DISTINCT x.person_id, CAST(x.e + 1 AS INTEGER) AS gap_start, CAST(min(y.s) - 1 AS INTEGER) AS gap_end
FROM q x JOIN q y ON x.person_id = y.person_id AND y.s > x.e + 1
WHERE NOT EXISTS (SELECT 1 FROM q z WHERE z.person_id = x.person_id AND z.s <= x.e + 1 AND z.e > x.e)
GROUP BY x.person_id, x.e
""",
    "p4_periods": f"""
WITH {SPANS},
r AS (SELECT *, max(e) OVER (PARTITION BY person_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM q),
g AS (SELECT *, sum(CASE WHEN until IS NULL OR s > until + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT person_id, CAST(CASE WHEN min(s) > -1000000 THEN min(s) END AS INTEGER) AS period_start, CAST(CASE WHEN max(e) < 1000000 THEN max(e) END AS INTEGER) AS period_end
FROM g GROUP BY person_id, k
""",
}
