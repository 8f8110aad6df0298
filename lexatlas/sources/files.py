"""Writing and reading tables: sorted, in shards, as decisions in CSV, and from lines of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, key: list[str], partitions: int | None = None) -> None:
    """Writes df sorted by key over the whole table, nulls last: ranges of the key are files, so readers can skip them. Spark commits all files at once."""
    order = [F.asc_nulls_last(k) for k in key]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_shards(df: DataFrame, path: str, key: str, shards: int) -> None:
    """Writes df in shards by a hash of key, a folder each, so that a reader of one key reads one shard."""
    n = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    df.withColumn("shard", n).repartition(shards, "shard").sortWithinPartitions("shard", key).write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, key: str, value, shards: int) -> DataFrame:
    """Rows of one key; only its shard is read."""
    shard = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value)), F.lit(shards))).first()[0]
    return spark.read.parquet(path).where((F.col("shard") == int(shard)) & (F.col(key) == value)).drop("shard")


def write_decisions(df: DataFrame, path: str) -> None:
    """Writes decisions as CSV with a header, sorted by all columns. Null and empty stay apart."""
    df.sort(*df.columns).write.mode("overwrite").csv(path, header=True, nullValue="\\N", escape='"')


def read_decisions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, nullValue="\\N", emptyValue="", escape='"', multiLine=True, mode="FAILFAST")


def read_json_lines(spark: SparkSession, path: str, schema: str, seek: list[str] | None = None) -> DataFrame:
    """Records of JSON lines, plain or gzip, with the fields of schema only. A line without any of `seek` isn't parsed; broken lines are left out."""
    lines = spark.read.text(path)
    if seek:
        some: Column = F.lit(False)
        for s in seek:
            some = some | F.col("value").contains(s)
        lines = lines.where(some)
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r IS NOT NULL").select("r.*")


def rebalanced(df: DataFrame, *by: str) -> DataFrame:
    """df in files of even size, by columns if given; Spark splits those that are skewed."""
    return df.hint("rebalance", *by)
