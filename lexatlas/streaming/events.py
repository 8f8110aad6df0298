"""Structured Streaming over events: windows, late data, and a merge of each micro-batch into what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.sources import Workspace

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """Files of events as they come into a folder."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", name).parquet(folder)


def windowed(events: DataFrame, width: str = "6 hours", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, value) of windows of event time; rows later than the watermark are left out, and state is dropped behind it."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def finished(spark: SparkSession, out: DataFrame, mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there and gives its last result: each micro-batch is one folder, of which the latest row of a key counts."""
    space = Workspace(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{space.path}/out/{number:08}")

    q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{space.path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    names = space.folders(f"{space.path}/out")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in out.schema)}, batch int"
    return spark.read.schema(schema).parquet(*(f"{space.path}/out/{n}" for n in names)) if names else spark.createDataFrame([], schema)


def stream_windows(spark, sf_dir):
    """Events of each type in windows of six hours, as a stream gives them."""
    rows = finished(spark, windowed(stream(spark, sf_dir)))
    last = rows.groupBy("start", "event_type").agg(F.max(F.struct("batch", "n", "value")).alias("x"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", F.col("x.n").alias("n"), F.round("x.value", 2).alias("value"))


def stream_users(spark, sf_dir):
    """Events and distinct types of each user, kept as state of a stream."""
    out = stream(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    last = finished(spark, out).groupBy("user_id").agg(F.max(F.struct("batch", "n", "most")).alias("x"))
    return last.select("user_id", F.col("x.n").alias("n"), F.col("x.most").alias("most"))


QUERIES = {f.__name__: f for f in (stream_windows, stream_users)}
SQL = {
    "stream_windows": "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "stream_users": "SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY 1",
}
