"""The queries that SQL can say, for DuckDB over the same tables."""

SIGNED = """
a AS (SELECT DISTINCT tid, pid FROM authorships WHERE tid IS NOT NULL AND pid IS NOT NULL),
k AS (SELECT tid FROM a GROUP BY tid HAVING count(*) <= 25),
s AS (SELECT a.tid, a.pid FROM a JOIN k USING (tid)),
m AS (SELECT pid, count(*) AS n FROM s GROUP BY pid),
ab AS (SELECT x.pid AS pid_a, y.pid AS pid_b, count(*) AS n_ab FROM s x JOIN s y ON x.tid = y.tid AND x.pid < y.pid GROUP BY 1, 2),
t AS (SELECT pid_a, pid_b, n_ab, p.n AS n_a, q.n AS n_b, (SELECT count(*) FROM k) AS n FROM ab JOIN m p ON p.pid = pid_a JOIN m q ON q.pid = pid_b WHERE n_ab >= 5)
"""
VOCABULARY = r"""
v AS (SELECT DISTINCT v.* FROM vocabulary v JOIN cohorts c ON v.cohort_id = c.cohort_id AND v.exported_at = c.exported_at),
t AS (SELECT trim(regexp_replace(lower(nfc_normalize(term)), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS term,
             CAST(coalesce(sum(n_entities), 0) AS BIGINT) AS n_entities, CAST(coalesce(sum(tf_total), 0) AS BIGINT) AS tf_total, count(*) AS records
      FROM v WHERE term IS NOT NULL GROUP BY 1),
m AS (SELECT *, CASE WHEN n_entities < 3 THEN 'rare' WHEN n_entities * 5 > (SELECT sum(n_entities) FROM cohorts) THEN 'common' END AS mark FROM t WHERE term <> '')
"""
LINKED = """
WITH RECURSIVE d AS (
  SELECT least(a, b) AS a, greatest(a, b) AS b, arg_max(lower(trim(decision)), decided_at) AS decision
  FROM pair_decisions WHERE decision IS NOT NULL AND a <> b GROUP BY 1, 2),
m AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM metrics WHERE a <> b AND NOT isnan(cosine) AND NOT isnan(threshold) AND cosine >= threshold),
l AS (SELECT a, b FROM d WHERE decision = 'merge' UNION
      SELECT m.a, m.b FROM m LEFT JOIN d ON m.a = d.a AND m.b = d.b WHERE d.decision IS NULL OR d.decision <> 'distinct'),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS person_id, a AS other FROM e UNION SELECT r.person_id, e.b FROM r JOIN e ON r.other = e.a)
"""
SQL = {
    "p2_found": f"WITH {VOCABULARY} SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p2_terms": f"WITH {VOCABULARY} SELECT * FROM m",
    "p3_found": f"{LINKED} SELECT person_id, min(other) AS group_id FROM r GROUP BY person_id",
    "p1_found": f"WITH {SIGNED} SELECT pid_a, pid_b FROM t WHERE n_ab * n >= 8 * n_a * n_b",
    "p1_pairs": f"WITH {SIGNED} SELECT *, CAST(n_ab * CAST(n AS DOUBLE) / (n_a * CAST(n_b AS DOUBLE)) AS DOUBLE) AS lift FROM t",
}
