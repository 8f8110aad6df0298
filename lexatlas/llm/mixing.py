"""Mixing sources to target weights (problem 8) by Efraimidis-Spirakis sampling without replacement."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexatlas.llm.tokens import encoded
from lexatlas.sources import Workspace, hint_small, table

SEED, BUCKET_ROWS = 42, 500_000


def source_key(c: str) -> Column:
    """The name of a source without case and all but letters and digits."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]", "")


def quality(text: str = "text") -> Column:
    """A weight from 0.1 to 1: the share of letters among the characters, which tables, mark-up and noise lower. 0.1 for null and empty texts."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.coalesce(0.1 + 0.9 * letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.1))


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, key, tokens, documents, total, wanted, most, short, budget, epochs, rest) of each source of a positive weight.

    sizes: (key, tokens, documents) of each source. total: tokens of the mix, or else those of all documents of these sources. budget is what
    the source gives: its share of total, or tokens * max_repeat where that is less (short). It is made of so many complete epochs and a rest.
    Weights null, NaN, zero or negative have no target; max_repeat null is 1 and negative is 0.
    """
    t = targets.where("weight > 0 AND NOT isnan(weight)").select("source", "weight", F.greatest(F.coalesce("max_repeat", F.lit(1)), F.lit(0)).cast("long").alias("max_repeat"), source_key("source").alias("key"))
    t = t.join(sizes, "key", "left").fillna(0, ["tokens", "documents"])
    # sources whose names are one share their documents; each is measured against all of them
    own = t.agg(F.sum("weight")).first()[0] or 0.0  # one number
    all_tokens = t.select("key", "tokens").distinct().agg(F.sum("tokens")).first()[0] or 0
    t = t.withColumn("total", F.lit(all_tokens).cast("long")).withColumn("wanted", F.col("weight") / F.lit(own))
    most, size = F.col("tokens") * F.col("max_repeat"), F.lit(total if total is not None else all_tokens)
    budget = F.least(F.floor(F.col("wanted") * size), most)
    t = t.withColumns({"most": most, "short": most < F.col("wanted") * F.col("total"), "budget": budget})
    epochs = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    return t.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def mixed(docs: DataFrame, plan: DataFrame, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, source, tokens, times) of every document that the mix uses, times being how often.

    docs: (doc_id, key, tokens, weight), plan: budgets(). A document has the key -ln(u) / weight, u a hash of seed and doc_id, and the smallest
    keys come first, so a document is drawn in proportion to its weight. All epochs but the last are complete; in the last, documents are taken
    in order while the sum of their tokens stays within the rest. Ties go by doc_id. Sums are those of key ranges first, then of the documents
    of the one range per source in which the rest ends; so no source is sorted whole, and no range has much more than bucket_rows documents.
    """
    space = Workspace(docs.sparkSession, "mix")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 1) / F.lit(float((1 << 53) + 1))
    plan = hint_small(plan)
    x = docs.join(plan.select("key", "source", "documents", "epochs", "rest"), "key").withColumn("at", -F.log(u) / F.greatest("weight", F.lit(1e-6)))
    # 1 - exp(-key) is even over 0 to 1 for weights of 1, and never far from it for others
    ranges = F.greatest(F.ceil(F.col("documents") / bucket_rows), F.lit(1))
    x = space.written(x.withColumn("range", F.floor((1 - F.exp(-F.col("at") * 0.8)) * ranges)))
    sums = x.groupBy("source", "range").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"))
    upto = F.sum("sum").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    sums = space.written(sums.select("source", "range", "rest", (upto - F.col("sum")).alias("before"), upto.alias("upto")))
    x = x.drop("rest").join(hint_small(sums), ["source", "range"])
    sure = x.where("upto <= rest").select("doc_id", "source", "tokens", "epochs", F.lit(1).alias("last"))
    split = x.where("before <= rest AND upto > rest")
    so_far = Window.partitionBy("source", "range").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    split = split.withColumn("last", (F.col("before") + F.sum("tokens").over(so_far) <= F.col("rest")).cast("int")).select(*sure.columns)
    over = x.where("before > rest").select("doc_id", "source", "tokens", "epochs", F.lit(0).alias("last"))
    all_ = sure.unionByName(split).unionByName(over)
    return all_.select("doc_id", "source", "tokens", (F.col("epochs") + F.col("last")).alias("times")).where("times > 0")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The budgets, and the documents that the mix uses."""
    space = Workspace(spark, "mixing")
    targets = table(spark, sf_dir, "mix_targets")
    named = table(spark, sf_dir, "documents").select("doc_id", source_key("source").alias("key"), "text", quality().alias("weight"))
    keys = targets.where("weight > 0 AND NOT isnan(weight)").select(source_key("source").alias("key")).distinct()
    named = named.join(hint_small(keys), "key", "left_semi")
    sized = encoded(named, "doc_id", "text").select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("tokens"))
    docs = space.written(named.select("doc_id", "key", "weight").join(sized, "doc_id"))
    sizes = docs.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    plan = space.written(budgets(sizes, targets))
    return plan, space.written(mixed(docs, plan))


def report(plan: DataFrame, mix: DataFrame) -> DataFrame:
    """(source, tokens, total, wanted, short, used, documents_used, reached): what each source gives to the mix, and its share of total."""
    used = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("used"), F.count("*").alias("documents_used"))
    r = plan.join(used, "source", "left").fillna(0, ["used", "documents_used"])
    return r.select("source", "tokens", "total", "wanted", "short", "used", "documents_used", F.coalesce(F.col("used") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)).alias("reached"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 8: sources that cannot reach their share, from the report of the mix."""
    return report(*_mix(spark, sf_dir)).where("short").select("source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 8: the share that each source reaches."""
    return report(*_mix(spark, sf_dir))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 8: the documents of the mix and how often each is used."""
    return _mix(spark, sf_dir)[1]
