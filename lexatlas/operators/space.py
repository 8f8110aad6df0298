"""Vectors: neighbours, Gram matrix and its decomposition, centroids and spread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexatlas.sources import Workspace, table

K, BLOCK, QUERY_BLOCK = 8, 4096, 2048
#: Groups of query blocks, each of which sees every block of rows.
GROUPS = 64


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _packed(size: int):
    """Rows (id, v) as blocks of `size` rows: (ids, data), data being unit vectors of float32."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def block(ids, rows):
            x = np.array(rows, np.float32)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            return ids, (x / np.where(n > 0, n, 1)).astype(np.float32).tobytes()

        ids, rows, out = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            rows += b.column(1).to_pylist()
            while len(ids) >= size:
                out.append(block(ids[:size], rows[:size]))
                ids, rows = ids[size:], rows[size:]
                yield pa.RecordBatch.from_arrays([pa.array([out[-1][0]], pa.list_(pa.int64())), pa.array([out[-1][1]], pa.binary())], ["ids", "data"])
        if ids:
            i, d = block(ids, rows)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.list_(pa.int64())), pa.array([d], pa.binary())], ["ids", "data"])

    return run


def _best(k: int):
    """Of blocks (q_ids, q_data, ids, data): the k nearest rows of each query in the block, itself left out."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for qi, qd, ri, rd in zip(*(c.to_pylist() for c in b.columns)):
                q, r = (np.frombuffer(d, np.float32).reshape(len(i), -1) for i, d in ((qi, qd), (ri, rd)))
                qi, ri = np.array(qi), np.array(ri)
                s = np.round((q @ r.T).astype(np.float64), 6)
                s[qi[:, None] == ri[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ri, s.shape), -s), axis=1)[:, :k]
                at = np.repeat(np.arange(len(qi)), order.shape[1])
                cos = s[at, order.ravel()]
                ok = np.isfinite(cos)
                yield pa.RecordBatch.from_arrays([pa.array(qi[at][ok]), pa.array(ri[order.ravel()][ok]), pa.array(cos[ok])], ["id", "other", "cosine"])

    return run


def knn(queries: DataFrame, rows: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """(id, other, cosine, place): the k rows (id, v) nearest to every query by cosine, exactly; ties by id.

    Queries and rows are packed into blocks, each pair of blocks is one product of matrices, and only the k best of a block move on.
    """
    space = Workspace(rows.sparkSession, "knn")
    q = space.written(queries.select("id", "v").mapInArrow(_packed(QUERY_BLOCK), "ids array<long>, data binary"))
    n = min(GROUPS, q.count())
    if n == 0:
        return rows.sparkSession.createDataFrame([], "id long, other long, cosine double, place int")
    q = q.select((F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(n)) + 1).cast("int").alias("block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    r = rows.select("id", "v").mapInArrow(_packed(block), "ids array<long>, data binary").select("ids", "data", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("block"))
    best = r.join(q, "block").select("q_ids", "q_data", "ids", "data").mapInArrow(_best(k), "id long, other long, cosine double")
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def jn11_knn(spark, sf_dir):
    """Neighbours of every hundredth vector among all vectors."""
    v = vectors(spark, sf_dir)
    return knn(v.where("id % 100 = 0"), v).select("id", "other", "place", F.round("cosine", 4).alias("cosine"))


def q9_edges(spark, sf_dir):
    """The neighbour edge list with the labels of both ends."""
    v = vectors(spark, sf_dir)
    e = knn(v.where("id % 100 = 0"), v, 3).select("id", "other", "place")
    return e.join(v.select("id", "label"), "id").join(v.select(F.col("id").alias("other"), F.col("label").alias("other_label")), "other").select("id", "other", "place", "label", "other_label")


def gr8_mutual(spark, sf_dir):
    """Pairs of every hundredth vector that are neighbours of each other among these."""
    v = vectors(spark, sf_dir).where("id % 100 = 0")
    e = Workspace(spark, "mutual").written(knn(v, v).select("id", "other"))
    return e.join(e.toDF("other", "id"), ["id", "other"]).where("id < other")


def mg13_mixing(spark, sf_dir):
    """How the neighbours of each label's queries spread over the labels."""
    v = vectors(spark, sf_dir)
    e = knn(v.where("id % 100 = 0"), v).select("id", "other")
    e = e.join(v.select("id", "label"), "id").join(v.select(F.col("id").alias("other"), F.col("label").alias("to")), "other").groupBy("label", "to").agg(F.count("*").alias("n"))
    return e.join(e.groupBy("label").agg(F.sum("n").alias("all")), "label").select("label", "to", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def gram(v: DataFrame) -> DataFrame:
    """(i, j, g), i <= j: sums of products of two dimensions over all vectors v. Each task adds up its own rows first."""

    def added(batches):
        import numpy as np
        import pyarrow as pa

        g = None
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist(), float)
                g = x.T @ x if g is None else g + x.T @ x
        if g is not None:
            i, j = np.triu_indices(len(g))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])], ["i", "j", "g"])

    return v.select("v").mapInArrow(added, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def sp3_gram(spark, sf_dir):
    return gram(vectors(spark, sf_dir)).select("i", "j", F.round("g", 4).alias("g"))


def svd(v: DataFrame, k: int):
    """(singular values, V, explained shares) by the Gram matrix, whose size is that of the dimensions, not of the rows. Of each vector of V the largest entry is positive."""
    import numpy as np

    rows = gram(v).collect()  # one for each pair of dimensions
    d = max(r.j for r in rows) + 1
    g = np.zeros((d, d))
    for r in rows:
        g[r.i, r.j] = g[r.j, r.i] = r.g
    values, vecs = np.linalg.eigh(g)
    values, vecs = np.maximum(values[::-1][:k], 0), vecs[:, ::-1][:, :k]
    vecs = vecs * np.sign(vecs[np.abs(vecs).argmax(0), np.arange(vecs.shape[1])])
    return np.sqrt(values), vecs, values / np.trace(g)


def sp1_projected(spark, sf_dir):
    """All vectors in the space of their first five right singular vectors."""
    import pyarrow as pa

    v = vectors(spark, sf_dir)
    _, base, _ = svd(v, 5)

    def run(batches):
        import numpy as np

        for b in batches:
            if b.num_rows:
                z = np.array(b.column(1).to_pylist(), float) @ base
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(z), pa.list_(pa.float64()))], ["id", "z"])

    return v.select("id", "v").mapInArrow(run, "id long, z array<double>")


def mp7_spread(spark, sf_dir):
    """Centre, covariance and correlation of each label's vectors in the first two dimensions."""
    x, y = F.get("v", F.lit(0)).cast("double"), F.get("v", F.lit(1)).cast("double")
    g = vectors(spark, sf_dir).select("label", x.alias("x"), y.alias("y")).groupBy("label")
    r = lambda c, name: F.round(c, 6).alias(name)
    return g.agg(F.count("*").alias("n"), r(F.avg("x"), "x"), r(F.avg("y"), "y"), r(F.var_samp("x"), "xx"), r(F.var_samp("y"), "yy"), r(F.covar_samp("x", "y"), "xy"), r(F.corr("x", "y"), "rho"))


def mp6_radius(spark, sf_dir):
    """Root mean square distance of each label's vectors from zero."""
    sq = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vectors(spark, sf_dir).groupBy("label").agg(F.round(F.sqrt(F.avg(sq)), 5).alias("radius"))


def q2_centroids(spark, sf_dir):
    """The mean vector of each label, a row for each dimension."""
    d = vectors(spark, sf_dir).select("label", F.posexplode("v").alias("dim", "x"))
    return d.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


def src17_int8(spark, sf_dir):
    """Vectors as whole numbers from -127 to 127, by the largest entry of each."""
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    q = F.transform("v", lambda x: F.floor(x.cast("double") * 127 / most + 0.5).cast("int"))
    return vectors(spark, sf_dir).where(most > 0).select("id", q.alias("q")).select("id", F.element_at("q", 1).alias("first"), F.aggregate("q", F.lit(0), lambda a, x: a + x).alias("sum"))


def mg18_auc(spark, sf_dir):
    """How well cosines tell pairs of one cohort from others, ties a half. Ranks come from the counts of each value, in ranges of a hundredth."""
    m = table(spark, sf_dir, "metrics").where("cosine IS NOT NULL AND NOT isnan(cosine)").select("cosine", F.coalesce(F.col("cohort_a") == F.col("cohort_b"), F.lit(False)).cast("long").alias("y"))
    h = m.groupBy("cosine").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).withColumn("range", F.floor(F.col("cosine") * 100))
    h = Workspace(spark, "auc").written(h)
    whole = h.groupBy("range").agg(F.sum("neg").alias("n"))
    # at most 201 ranges
    before = whole.alias("a").join(whole.toDF("r", "m"), F.col("r") < F.col("range"), "left").groupBy("range").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("before"))
    own = F.sum("neg").over(Window.partitionBy("range").orderBy("cosine").rowsBetween(Window.unboundedPreceding, 0)) - F.col("neg")
    x = h.withColumn("own", own).join(before, "range")
    t = x.agg(F.sum(F.col("pos") * (F.col("before") + F.col("own") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return t.select("p", "n", F.round(F.col("u") / (F.col("p") * F.col("n")), 6).alias("auc"))


QUERIES = {f.__name__: f for f in (jn11_knn, q9_edges, gr8_mutual, mg13_mixing, sp3_gram, sp1_projected, mp7_spread, mp6_radius, q2_centroids, src17_int8, mg18_auc)}
_V = """
v AS (SELECT vec_id AS id, embedding AS e, label, CAST(embedding AS DOUBLE[]) AS d FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT id, label, list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS d FROM v)
"""
_N = "n AS (SELECT q.id, r.id AS other, q.label, r.label AS other_label, round(list_dot_product(q.d, r.d), 6) AS cosine, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.d, r.d), 6) DESC, r.id) AS place FROM u q JOIN u r ON q.id <> r.id WHERE q.id % 100 = 0)"
SQL = {
    "jn11_knn": f"WITH {_V}, {_N} SELECT id, other, CAST(place AS INTEGER) AS place, round(cosine, 4) AS cosine FROM n WHERE place <= {K}",
    "q9_edges": f"WITH {_V}, {_N} SELECT id, other, CAST(place AS INTEGER) AS place, label, other_label FROM n WHERE place <= 3",
    "gr8_mutual": f"WITH {_V}, m AS (SELECT q.id, r.id AS other, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.d, r.d), 6) DESC, r.id) AS place FROM u q JOIN u r ON q.id <> r.id WHERE q.id % 100 = 0 AND r.id % 100 = 0) SELECT x.id, x.other FROM m x JOIN m y ON x.id = y.other AND x.other = y.id WHERE x.place <= {K} AND y.place <= {K} AND x.id < x.other",
    "mg13_mixing": f'WITH {_V}, {_N}, c AS (SELECT label, other_label AS "to", count(*) AS n FROM n WHERE place <= {K} GROUP BY 1, 2) SELECT label, "to", n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM c',
    "sp3_gram": f"WITH {_V}, x AS (SELECT id, unnest(d) AS a, generate_subscripts(d, 1) - 1 AS i FROM v) SELECT CAST(x.i AS INTEGER) AS i, CAST(y.i AS INTEGER) AS j, round(sum(x.a * y.a), 4) AS g FROM x JOIN x y ON x.id = y.id AND x.i <= y.i GROUP BY 1, 2",
    "mp7_spread": f"WITH {_V}, x AS (SELECT label, d[1] AS x, d[2] AS y FROM v) SELECT label, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(var_samp(x), 6) AS xx, round(var_samp(y), 6) AS yy, round(covar_samp(x, y), 6) AS xy, round(corr(x, y), 6) AS rho FROM x GROUP BY 1",
    "mp6_radius": f"WITH {_V} SELECT label, round(sqrt(avg(list_dot_product(d, d))), 5) AS radius FROM v GROUP BY 1",
    "q2_centroids": f"WITH {_V}, x AS (SELECT label, unnest(d) AS a, generate_subscripts(d, 1) - 1 AS i FROM v) SELECT label, CAST(i AS INTEGER) AS dim, round(avg(a), 5) AS mean FROM x GROUP BY 1, 2",
    "src17_int8": f"WITH {_V}, m AS (SELECT id, d, list_max(list_transform(d, lambda x: abs(x))) AS m FROM v), q AS (SELECT id, list_transform(d, lambda x: CAST(floor(x * 127 / m + 0.5) AS INTEGER)) AS q FROM m WHERE m > 0) SELECT id, q[1] AS first, CAST(list_sum(q) AS INTEGER) AS sum FROM q",
    "mg18_auc": "WITH m AS (SELECT cosine, coalesce(cohort_a = cohort_b, false)::INT AS y FROM metrics WHERE cosine IS NOT NULL AND NOT isnan(cosine)), r AS (SELECT y, rank() OVER (ORDER BY cosine) + (count(*) OVER (PARTITION BY cosine) - 1) / 2 AS k FROM m), s AS (SELECT CAST(sum(y) AS BIGINT) AS p, CAST(sum(1 - y) AS BIGINT) AS n, sum(CASE WHEN y = 1 THEN k END) AS k FROM r) SELECT p, n, round((k - p * (p + 1) / 2) / (p * n), 6) AS auc FROM s",
}
