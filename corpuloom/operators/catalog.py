"""Finding, sorting, rolling up and summing up files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_matches, size_literal

SORTABLE = ("size", "name", "path", "ext", "kind", "modified", "created", "depth")
PREFERRED = ("path", "name", "kind", "size", "ext", "width", "height", "modified", "mime", "depth")


def find(
    files: DataFrame,
    *,
    kind: str | list[str] | None = None,
    ext: str | list[str] | None = None,
    min_size: str | int | None = None,
    max_size: str | int | None = None,
    name: str | None = None,
    ignore_case: bool = False,
    max_depth: int | None = None,
    sort: str | None = None,
    descending: bool = False,
    limit: int | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Filters by all that is given, sorts (ties by path), limits and projects, as one lazy plan.

    kind and ext take a comma-separated text or a list; an unknown sort column is an error.
    """
    out = files
    if kind is not None:
        out = out.where(F.col("kind").isin(*_listed(kind)))
    if ext is not None:
        out = out.where(F.col("ext").isin(*_listed(ext)))
    if min_size is not None:
        out = out.where(F.col("size") >= size_literal(min_size))
    if max_size is not None:
        out = out.where(F.col("size") <= size_literal(max_size))
    if name is not None:
        out = out.where(name_matches(F.col("name"), name, ignore_case))
    if max_depth is not None:
        out = out.where(F.col("depth") <= max_depth)
    if sort is not None:
        if sort not in SORTABLE:
            raise ValueError(f"cannot sort by {sort!r}; one of {', '.join(SORTABLE)}")
        out = out.orderBy(F.col(sort).desc() if descending else F.col(sort).asc(), F.col("path").desc() if descending else F.col("path").asc())
    if limit is not None:
        out = out.limit(limit)
    return out.select(*columns) if columns else out


def _listed(value: str | list[str]) -> list[str]:
    return [x.strip() for x in value.split(",")] if isinstance(value, str) else list(value)


def shown_columns(df: DataFrame, most: int = 10) -> list[str]:
    """Up to so many columns, the preferred ones first."""
    return [*(x for x in PREFERRED if x in df.columns), *(x for x in df.columns if x not in PREFERRED)][:most]


def in_scope(files: DataFrame, prefix: str, *, column: str = "uri", loose: bool = False) -> DataFrame:
    """What lies below a prefix; loose: also what merely starts with it (/a/bc for /a/b)."""
    return files.where(F.col(column).startswith(prefix if loose else prefix.rstrip("/") + "/"))


def without_noise(files: DataFrame) -> DataFrame:
    """Without the resource forks and folder settings of desktop systems."""
    return files.where(~(F.col("name").startswith("._") | (F.col("name") == ".DS_Store")))


def searchable(files: DataFrame) -> DataFrame:
    """What a text search reads: no top-level hidden path, no binary except documents."""
    return files.where(~F.col("path").startswith(".") & (~F.col("is_binary") | (F.col("kind") == "document")))


def rollup(files: DataFrame) -> DataFrame:
    """dir, files and bytes of each directory, with all below it; "" is the root."""
    parts = F.split("parent", "/")
    prefixes = F.when(F.col("parent") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    # Summed by parent first, so that what is exploded is one row a directory.
    each = files.groupBy("parent").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    return each.select(F.explode(prefixes).alias("dir"), "n", "s").groupBy("dir").agg(F.sum("n").alias("files"), F.sum("s").alias("bytes"))


def info(files: DataFrame, top: int = 5) -> dict[str, DataFrame]:
    """Totals, counts by kind and the most frequent extensions."""
    return {
        "totals": files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")),
        "kinds": files.groupBy("kind").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "kind"),
        "extensions": files.where(F.col("ext") != "").groupBy("ext").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ext").limit(top),
    }


def unindexed(on_disk: DataFrame, stored: DataFrame) -> DataFrame:
    """uris on disk that the store lacks."""
    return on_disk.select("uri").join(stored.select("uri"), "uri", "left_anti").distinct()


def prune_candidates(stored: DataFrame, on_disk: DataFrame, prefix: str | None = None) -> DataFrame:
    """Stored uris (below prefix) that are not on disk."""
    known = in_scope(stored, prefix) if prefix else stored
    return known.select("uri").join(on_disk.select("uri"), "uri", "left_anti")


def stale(current: DataFrame, known: DataFrame) -> DataFrame:
    """uris of current that known lacks, or has with another time or size."""
    was = known.select("uri", F.col("modified").alias("_modified"), F.col("size").alias("_size"), F.lit(True).alias("_known"))
    both = current.join(was, "uri", "left")
    return both.where(F.col("_known").isNull() | ~F.col("modified").eqNullSafe(F.col("_modified")) | ~F.col("size").eqNullSafe(F.col("_size"))).select("uri")


def directory_hash(files: DataFrame) -> DataFrame:
    """dir and a hash of its files' sorted path:time:size, without hidden files.

    Files are hashed one by one and combined by a sum of their hashes within sub-buckets first, so a
    directory of very many files is not one row's text.
    """
    visible = files.where(~F.col("name").startswith("."))
    entry = F.concat_ws(":", "path", F.col("modified").cast("string"), F.col("size").cast("string"))
    keyed = visible.select(F.col("parent").alias("dir"), F.sha2(entry, 256).alias("h")).withColumn("part", F.left("h", F.lit(2)))
    parts = keyed.groupBy("dir", "part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return parts.groupBy("dir").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), 256).alias("dir_hash"))


def picked_first(files: DataFrame, kind: str, order: str = "path") -> DataFrame:
    """The first file of a kind."""
    return files.where(F.col("kind") == kind).orderBy(order).limit(1)


def picked_smallest(files: DataFrame, kind: str) -> DataFrame:
    """The smallest file of a kind, the first path of equal ones; files of unknown size come last."""
    return files.where(F.col("kind") == kind).orderBy(F.col("size").asc_nulls_last(), "path").limit(1)


def picked(files: DataFrame, kind: str, n: int) -> DataFrame:
    """slot and path of n files of a kind, at equal steps in order of name; fewer files are taken again and again."""
    from .store import numbered

    some = numbered(files.where(F.col("kind") == kind).select("name", "path"), ["name", "path"], -1, "at")
    m = some.agg(F.count("*")).first()[0]
    slots = [(i, i * m // n if m >= n else i % m) for i in range(n)] if m else []
    wanted = files.sparkSession.createDataFrame(slots, "slot int, at bigint")
    return some.join(F.broadcast(wanted), "at").select("slot", "path")


def merged_paths(scanned: DataFrame, piped: DataFrame) -> DataFrame:
    """scanned and the piped files whose path is not among them, each path once."""
    rest = piped.dropDuplicates(["path"]).join(scanned.select("path"), "path", "left_anti")
    return scanned.dropDuplicates(["path"]).unionByName(rest.select(*scanned.columns))
