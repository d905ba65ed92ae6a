"""Keyed tables in hash buckets: changes rewrite only the buckets they touch, and versions can be compared.

A table's rows lie in Parquet folders, one or a few for each bucket of a hash of its placing column.
A version is a manifest that names each table's folders for each bucket; it is a few bytes a
bucket, whatever the rows.  A change writes new folders for the buckets it touches, then a
manifest that takes all others from the version before, then claims the version's number
by creating its pointer, which fails if another writer has it.  One manifest holds all
tables, so a change of several is seen whole or not at all.  Nothing is written over what
may be read: readers keep the version they opened until it is ``keep`` versions old.

What is new between two versions is read from the buckets whose folders differ alone.

Defined results: rows whose placing column is null share a bucket; of a change that was lost
before its pointer, nothing is seen; a table without rows or that was never written is empty.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Versions that stay readable, and seconds after which a pointer without a manifest is taken to be lost.
KEEP, LOST = 10, 60
#: Folders that a bucket may have before rows that come to it are put together with those that it holds.
FOLDERS = 8


class Table(NamedTuple):
    """Columns, the column that tells rows apart, and the one whose hash is their bucket."""

    schema: T.StructType
    key: str
    place: str


class Conflict(RuntimeError):
    """Another writer made the next version first; nothing was changed."""


class Manifest(NamedTuple):
    """For each table and bucket its folders, joined by commas."""

    version: int
    tables: dict[str, dict[int, str]]


class Buckets:
    """Tables below a folder of any file system; buckets stays as it was when the folder was first written."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], buckets: int = 64, keep: int = KEEP):
        self.spark, self.root, self.tables, self.keep = spark, root.rstrip("/"), tables, keep
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = self._settled(buckets)

    # ------------------------------------------------------------ files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _write(self, name: str, text: str) -> None:
        """Fails if the file is there."""
        out = self._fs.create(self._path(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _settled(self, buckets: int) -> int:
        if not self._fs.exists(self._path("_buckets")):
            return buckets
        return int(self._read("_buckets"))

    def _pointers(self) -> list[int]:
        folder = self._path("_versions")
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _body(self, version: int) -> str:
        """The manifest file that a pointer names; empty while its writer has not got so far."""
        return self._read(f"_versions/{version}").strip()

    # ------------------------------------------------------------ versions

    def version(self, table: str | None = None) -> int:
        """The last version; 0 without any."""
        return next((v for v in reversed(self._pointers()) if self._body(v)), 0)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.version() if version is None else version
        if not version:
            return Manifest(0, {})
        found = json.loads(self._read(self._body(version)))
        return Manifest(version, {t: {int(b): p for b, p in parts.items()} for t, parts in found.items()})

    def bucket(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def touched(self, table: str, rows: DataFrame, column: str | None = None) -> list[int]:
        """The buckets of a table that hold what column names; no more than there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(F.col(column or self.tables[table].place))).distinct().collect())

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None, of: Manifest | None = None) -> DataFrame:
        parts = (of or self.manifest(version)).tables.get(table, {})
        folders = [f"{self.root}/{p}" for b, place in sorted(parts.items()) if buckets is None or b in set(buckets) for p in place.split(",")]
        schema = self.tables[table].schema
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def staged(self, table: str, rows: DataFrame, buckets: list[int] | None = None, meet: bool = True) -> dict[int, str | None]:
        """Writes rows, all that the buckets (or all) hold from now on; the folder of each bucket, null where it is empty now.

        Rows meet by bucket before they are written; Spark divides large buckets and their files.  Unless
        meet, they are written where they lie: nothing moves, and each task writes a file for each bucket.
        """
        folder = f"{table}/{uuid.uuid4().hex}"
        if not self._fs.exists(self._path("_buckets")):
            self._write("_buckets", str(self.buckets))
        placed = rows.select(*self.tables[table].schema.names, self.bucket(F.col(self.tables[table].place)).alias("bucket"))
        (placed.hint("rebalance", "bucket") if meet else placed).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{folder}")
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(folder))]
        made = {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith("bucket=")}
        return {b: made.get(b) for b in (range(self.buckets) if buckets is None else buckets)}

    def room(self, base: Manifest, table: str, buckets: list[int]) -> bool:
        """Whether each of the buckets may have one folder more."""
        parts = base.tables.get(table, {})
        return all(len(parts[b].split(",")) < FOLDERS for b in buckets if b in parts)

    def commit(self, base: Manifest, staged: dict[str, dict[int, str | None]], beside: bool = False) -> int:
        """Makes base with the staged buckets the next version, all tables at once; Conflict if base is not the last any more.

        beside: what is staged comes to what the buckets hold, not in its place.
        """
        tables = {t: dict(parts) for t, parts in base.tables.items()}
        for table, parts in staged.items():
            now = tables.setdefault(table, {})
            for b, place in parts.items():
                old = now.pop(b, None)
                both = [p for p in (old if beside else None, place) if p is not None]
                if both:
                    now[b] = ",".join(both)
        body, version = f"_manifests/{uuid.uuid4().hex}.json", base.version + 1
        self._write(body, json.dumps(tables))
        self._claim(version, body)
        self._forget(version - self.keep)
        return version

    def _claim(self, version: int, body: str) -> None:
        pointer = f"_versions/{version}"
        if self._fs.exists(self._path(pointer)) and not self._body(version):
            age = time.time() - self._fs.getFileStatus(self._path(pointer)).getModificationTime() / 1000
            if age > LOST:
                self._fs.delete(self._path(pointer), False)
        try:
            self._write(pointer, body)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {version} of {self.root} was made by another writer") from None
            raise

    def _forget(self, version: int) -> None:
        """Removes a version, and the folders that only it names."""
        if version < 1 or version not in self._pointers() or not self._body(version):
            return
        gone, after = self.manifest(version), self.manifest(version + 1)
        folders = lambda of: {p for parts in of.tables.values() for place in parts.values() for p in place.split(",")}
        # A folder leaves a manifest once and does not come back.
        for place in folders(gone) - folders(after):
            self._fs.delete(self._path(place), True)
        body = self._body(version)
        self._fs.delete(self._path(f"_versions/{version}"), False)
        self._fs.delete(self._path(body), False)

    # ------------------------------------------------------------ changes

    def write(self, table: str, rows: DataFrame) -> int:
        """Makes rows all that the table holds."""
        base = self.manifest()
        return self.commit(base, {table: self.staged(table, rows)})

    def put(self, table: str, rows: DataFrame) -> int:
        """Puts rows in by key, in place of those of the same key; of rows that share one, any stays.

        A row whose placing column changes its bucket is found in its old one only where the key is the place.
        """
        base, key = self.manifest(), self.tables[table].key
        buckets = self.touched(table, rows)
        fresh = rows.dropDuplicates([key])
        old = self.read(table, buckets=buckets, of=base)
        now = old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))
        return self.commit(base, {table: self.staged(table, now, buckets)})

    def remove(self, table: str, keys: DataFrame) -> int:
        """Takes out the rows whose placing column is among keys (a column of that name)."""
        base, place = self.manifest(), self.tables[table].place
        buckets = self.touched(table, keys)
        old = self.read(table, buckets=buckets, of=base)
        return self.commit(base, {table: self.staged(table, old.join(keys.select(place), place, "left_anti").select(*old.columns), buckets)})

    def changes(self, table: str, since: int, until: int | None = None) -> DataFrame:
        """key, change (added, changed or gone), before and after (structs of all columns) between two versions.

        Reads the buckets whose folders differ; a version 0 is an empty table.
        """
        old, new = self.manifest(since) if since else Manifest(0, {}), self.manifest(until)
        a, b = old.tables.get(table, {}), new.tables.get(table, {})
        differ = [x for x in range(self.buckets) if a.get(x) != b.get(x)]
        key, names = self.tables[table].key, self.tables[table].schema.names
        side = lambda of, name: self.read(table, buckets=differ, of=of).select(F.col(key).alias(f"_{name}"), F.struct(*names).alias(name))
        both = side(old, "before").join(side(new, "after"), F.col("_before") == F.col("_after"), "full")
        kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "gone").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
        return both.select(F.coalesce("_after", "_before").alias(key), kind.alias("change"), "before", "after").where("change IS NOT NULL")
