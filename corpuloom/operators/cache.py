"""Results kept by the content they were made from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import cache_key


def keyed(rows: DataFrame, *arguments: str, path: str = "path", modified: str = "modified", size: str = "size") -> DataFrame:
    """Adds cache_key, of a file's path, time and size and the arguments; null where the file is missing (no time)."""
    fingerprint = F.concat_ws("\x1f", path, F.col(modified).cast("string"), F.col(size).cast("string"))
    return rows.withColumn("cache_key", F.when(F.col(modified).isNotNull(), cache_key(fingerprint, *(F.lit(x) for x in arguments))))


class Cache:
    """A folder of Parquet parts of (cache_key, columns); each call adds what it had to compute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _known(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(self.folder).dropDuplicates(["cache_key"])

    def through(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """compute(rows), which keeps cache_key, for what is not known yet; then all results of rows.

        Rows without a key are computed each time and not kept.
        """
        with_key, without = rows.where("cache_key IS NOT NULL"), rows.where("cache_key IS NULL")
        known = self._known()
        todo = with_key if known is None else with_key.join(known.select("cache_key"), "cache_key", "left_anti")
        compute(todo.dropDuplicates(["cache_key"])).write.mode("append").parquet(self.folder)
        kept = self._known()
        return kept.join(with_key.select("cache_key").distinct(), "cache_key", "left_semi").unionByName(compute(without).select(*kept.columns))
