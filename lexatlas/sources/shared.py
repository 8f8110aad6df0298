"""Intermediate tables in the shared folder, and joins that withstand hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only up to so many rows; beyond, Spark joins by sort or hash.
SMALL_ROWS = 20_000
#: A key with so many rows is hot; at most HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 200_000, 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset, as in tests, a temporary one."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="lexatlas-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


class Workspace:
    """A folder of one computation in the shared folder. Tables written here cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self._n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._leave)

    def written(self, df: DataFrame, *partition: str, path: str | None = None) -> DataFrame:
        """df, written once and read back."""
        self._n += 1
        path = path or f"{self.path}/{self._n:05}"
        writer = df.write.partitionBy(*partition) if partition else df.write
        writer.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._lexatlas_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Removes a table that nothing will read again."""
        self.remove(df._lexatlas_path)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def folders(self, path: str) -> list[str]:
        """Names of the folders in path."""
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def _leave(self) -> None:
        try:
            self.remove(self.path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass


def hint_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """left join right on key, which is unique in right, however many rows of left one key has.

    Rows of hot keys meet a broadcast of their few rows of right, of which there are HOT_KEYS at most; the rest is shuffled by key.
    left should be a written table, as it is read more than once.
    """
    n = left.count()
    hot = left.groupBy(key).count().where(F.col("count") >= max(hot_rows, n // HOT_KEYS)).select(key) if n >= hot_rows else None
    if hot is None or hot.isEmpty():
        return left.join(right, key, how)
    hot = F.broadcast(hot)
    rest = left.join(hot, key, "left_anti").join(right, key, how)
    return left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how).unionByName(rest)
