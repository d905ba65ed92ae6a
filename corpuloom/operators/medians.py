"""Exact medians of groups of any size, by narrowing ranges until few values are left.

Each group's middle ranks (one, or two where its count is even) are looked for at once.  A
round divides the range that holds a rank into BINS, counts values by bin (partial counts
first, so no group is gathered anywhere), and keeps the bin of the rank with its own least
and largest value.  A rank is found when its bin holds one value, however often, and its
last FEW rows are sorted otherwise.  As least and largest value fall into different bins,
every round leaves some values out; ranges shrink by BINS.

Defined results: null and NaN values are left out; a group of none has a null median; groups
of null keys are groups; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

BINS, FEW = 1024, 1024


def exact_medians(rows: DataFrame, keys: list[str], value: str, column: str = "median") -> DataFrame:
    """keys and the median of a numeric column, as a double."""
    names = [f"_k{i}" for i in range(len(keys))]
    slim = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(value).cast("double").alias("_v"))
    good = slim.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    same = lambda other: [F.col(n).eqNullSafe(F.col(f"{other}{n}")) for n in names]
    groups = cut(slim.groupBy(*names).agg(F.count(F.when(~F.isnan("_v"), F.col("_v"))).alias("_n"), F.min(F.when(~F.isnan("_v"), F.col("_v"))).alias("_low"), F.max(F.when(~F.isnan("_v"), F.col("_v"))).alias("_high")))
    ranks = F.array_distinct(F.array(F.floor((F.col("_n") + 1) / 2).cast("bigint"), F.floor((F.col("_n") + 2) / 2).cast("bigint")))
    # A row for each rank that is looked for; rank counts from 1 within the range.
    open_ = groups.where("_n > 0").select(*names, F.col("_n").alias("_of"), "_low", "_high", F.explode(ranks).alias("_rank")).withColumn("_id", F.col("_rank"))
    found = None
    while True:
        done = F.col("_low") == F.col("_high")
        new = open_.where(done).select(*names, "_id", F.col("_low").alias("_v"))
        small = open_.where(~done & (F.col("_of") <= FEW))
        held = _within(good, small, names, same)
        place = F.row_number().over(Window.partitionBy(*(f"o{n}" for n in names), "_id").orderBy("_v"))
        sorted_ = held.withColumn("_place", place).where(F.col("_place") == F.col("_rank")).select(*(F.col(f"o{n}").alias(n) for n in names), "_id", "_v")
        found = cut(new.unionByName(sorted_) if found is None else found.unionByName(new).unionByName(sorted_))
        open_ = open_.where(~done & (F.col("_of") > FEW))
        if open_.isEmpty():
            break
        # Halves first: the difference of very large numbers of both signs is none.
        width = F.col("_high") / 2 - F.col("_low") / 2
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("_v") / 2 - F.col("_low") / 2) / width * BINS).cast("int"))
        counted = _within(good, open_, names, same).withColumn("_bin", bin_)
        by = [*(f"o{n}" for n in names), "_id", "_rank"]
        bins = counted.groupBy(*by, "_bin").agg(F.count("*").alias("_of"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = F.sum("_of").over(Window.partitionBy(*by).orderBy("_bin")) - F.col("_of")
        kept = bins.withColumn("_before", before).where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_of")))
        open_ = cut(kept.select(*(F.col(f"o{n}").alias(n) for n in names), "_of", "_low", "_high", (F.col("_rank") - F.col("_before")).alias("_rank"), "_id"))
    middle = found.groupBy(*names).agg((F.min("_v") / 2 + F.max("_v") / 2).alias("_m"))
    middle = middle.select(*(F.col(n).alias(f"m{n}") for n in names), "_m")
    on = same("m")
    both = groups.join(middle, on, "left") if on else groups.join(middle, F.lit(True), "left")
    return both.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), F.col("_m").alias(column))


def _within(good: DataFrame, open_: DataFrame, names: list[str], same) -> DataFrame:
    """The values in each open range, with the range's columns (keys as o_k0, ...)."""
    ranges = open_.select(*(F.col(n).alias(f"o{n}") for n in names), "_low", "_high", "_rank", "_id", "_of")
    return good.join(ranges, [*same("o"), F.col("_v").between(F.col("_low"), F.col("_high"))]).select(*(f"o{n}" for n in names), "_v", "_low", "_high", "_rank", "_id")
