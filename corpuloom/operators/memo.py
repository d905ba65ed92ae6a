"""Results kept by key up to a budget of bytes; those unused for longest go first.

The log of uses is a table of its own with a row for each key, its last use.  What is over
the budget is found by a running sum of bytes in order of recency: keys are dealt into
ranges of that order, ranges are summed, and each key's sum is its range's sum so far and
the ranges before, so no task holds more than a range.  Entries and uses change in one
version, by bucket (see buckets.py).

Defined results: keys never used are older than any use; of equal uses the smaller key is
the more recent; an entry that is larger than the budget goes; rows without a key are
computed each time and not kept; null sizes are 0; a budget of None keeps all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut
from .buckets import Buckets, Table


def running_totals(rows: DataFrame, order: list[str | Column], value: str, column: str) -> DataFrame:
    """Adds the sum of value of all rows up to each in order; order names every row's place."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    within = dealt.withColumn("_sum", F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    # A row for each range.
    sums = dealt.groupBy(F.col("_part").alias("_p")).agg(F.sum(value).alias("_s"))
    before = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return within.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(column, F.col("_sum") + F.col("_before")).select(*rows.columns, column)


def evictions(entries: DataFrame, uses: DataFrame, budget: int) -> DataFrame:
    """cache_key, bytes, used and total (bytes of it and all more recent ones) of the entries (cache_key, bytes) that are over the budget; uses: cache_key, used."""
    last = uses.groupBy("cache_key").agg(F.max("used").alias("used"))
    known = entries.groupBy("cache_key").agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes")).join(last, "cache_key", "left")
    return running_totals(known, [F.desc_nulls_last("used"), F.asc("cache_key")], "bytes", "total").where(F.col("total") > budget)


class Memo(Buckets):
    """A cache below a folder: rows of some columns by cache_key, at most budget bytes of them."""

    def __init__(self, spark: SparkSession, root: str, shape: str, budget: int | None = None, buckets: int = 16):
        schema = spark.createDataFrame([], f"cache_key string, {shape}").schema
        uses = T.StructType([T.StructField("cache_key", T.StringType()), T.StructField("used", T.LongType()), T.StructField("bytes", T.LongType())])
        super().__init__(spark, root, {"entries": Table(schema, "cache_key", "cache_key"), "uses": Table(uses, "cache_key", "cache_key")}, buckets)
        self.budget = budget

    def through(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], now: int, size: Column) -> DataFrame:
        """The kept or computed rows of all keys of rows; compute gives cache_key and the cache's columns, once for each key.

        now: when the keys count as used; size: the bytes of a computed row, of its columns.
        """
        base, names = self.manifest(), self.tables["entries"].schema.names
        asked = cut(rows.where("cache_key IS NOT NULL").dropDuplicates(["cache_key"]))
        touched = self.touched("entries", asked)
        stored = self.read("entries", buckets=touched, of=base)
        hits = cut(stored.join(asked.select("cache_key"), "cache_key", "left_semi").select(*names))
        made = cut(compute(asked.join(hits.select("cache_key").distinct(), "cache_key", "left_anti")).select(*names))
        without = compute(rows.where("cache_key IS NULL")).select(*names)
        was = self.read("uses", buckets=touched, of=base)
        sizes = made.withColumn("_size", size).groupBy("cache_key").agg(F.coalesce(F.sum("_size"), F.lit(0)).cast("bigint").alias("bytes"))
        again = was.join(asked.select("cache_key"), "cache_key", "left_semi").select("cache_key", F.lit(now).cast("bigint").alias("used"), "bytes")
        fresh = again.unionByName(sizes.select("cache_key", F.lit(now).cast("bigint").alias("used"), "bytes"))
        others = was.join(fresh.select("cache_key"), "cache_key", "left_anti")
        self.commit(base, {"entries": self.staged("entries", stored.unionByName(made), touched), "uses": self.staged("uses", others.unionByName(fresh), touched)})
        self.trim()
        return hits.unionByName(made).unionByName(without)

    def trim(self) -> int:
        """Evicts what is over the budget; how many keys that was."""
        base = self.manifest()
        uses = self.read("uses", of=base)
        held = uses.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        if self.budget is None or held <= self.budget:
            return 0
        gone = cut(evictions(uses.select("cache_key", "bytes"), uses, self.budget).select("cache_key"))
        touched = self.touched("entries", gone)
        left = {t: self.staged(t, self.read(t, buckets=touched, of=base).join(gone, "cache_key", "left_anti").select(*self.tables[t].schema.names), touched) for t in ("entries", "uses")}
        self.commit(base, left)
        return gone.count()
