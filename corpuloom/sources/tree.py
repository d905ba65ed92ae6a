"""A directory as a Spark data source: tasks walk sub-trees, filters reach the walk.

The driver lists folders from the top until there are enough sub-trees for the tasks, and
holds nothing but their names.  Each task walks its own, with the ignore rules of the folders
above read once more, and makes Arrow batches.  Filters on ext, kind and size are taken over
by the walk, so that other files give no row; those on size cost a stat, the others none.

The folder must be one that all executors see under the same path.

Defined results: as files.scan(); an unreadable folder gives nothing; a root that is no
folder is an error; files that vanish while they are listed are left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .. import schema
from ..session import workers_find_us
from .files import IgnoreRules, _read_rules, classified, image_sizes

SHAPE = "path string, ext string, kind string, size bigint, modified bigint, created bigint"
#: Sub-trees that the driver looks for, and rows in a batch.
PARTS, BATCH = 256, 4096
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

_KINDS = {ext: kind for kind, exts in schema.KINDS.items() for ext in exts}


def extension(name: str) -> str:
    """As written, with its dot; empty if the name has none or ends in a dot."""
    stem, dot, last = name.rpartition(".")
    return f".{last}" if dot and stem and last else ""


class Part(InputPartition):
    """Folders to list, and whether what lies below each is listed too."""

    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(None)
        self.folders = folders


class Walk:
    """Entries of folders below root that no ignore rule leaves out."""

    def __init__(self, root: str, no_ignore: bool):
        self.root, self.no_ignore = Path(root), no_ignore

    def rules_above(self, folder: str) -> list[IgnoreRules]:
        """The rules that hold where a folder's own begin: the user's, the repository's and those of all folders above."""
        if self.no_ignore:
            return []
        home = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config")
        rules = [*_read_rules(home / "git" / "ignore"), *_read_rules(self.root / ".git" / "info" / "exclude")]
        names = folder.split("/") if folder else []
        for n in range(len(names)):
            rules = self.with_own(rules, "/".join(names[:n]))
        return rules

    def with_own(self, rules: list[IgnoreRules], folder: str) -> list[IgnoreRules]:
        if self.no_ignore:
            return rules
        here = self.root / folder
        return [*rules, *_read_rules(here / ".gitignore", folder), *_read_rules(here / ".ignore", folder)]

    def entries(self, folder: str, rules: list[IgnoreRules]) -> Iterator[tuple[str, bool, os.DirEntry]]:
        """(path, whether it is a folder, entry); the last rule of the innermost file that fits decides."""
        try:
            found = list(os.scandir(self.root / folder))
        except (PermissionError, FileNotFoundError):
            return
        for entry in found:
            if entry.is_symlink() or (entry.name == ".git" and not self.no_ignore):
                continue
            path, is_dir = f"{folder}/{entry.name}" if folder else entry.name, entry.is_dir(follow_symlinks=False)
            verdicts = (r.verdict(path, is_dir) for r in reversed(rules))
            if not next((v for v in verdicts if v is not None), False):
                yield path, is_dir, entry

    def roots(self, wanted: int) -> list[tuple[str, bool]]:
        """Sub-trees, at least wanted of them where there are so many, and the folders above them as themselves."""
        alone, trees = [], [""]
        while trees and len(trees) < wanted:
            below = []
            for folder in trees:
                rules = self.with_own(self.rules_above(folder), folder)
                below += [path for path, is_dir, _ in self.entries(folder, rules) if is_dir]
            alone += [(f, False) for f in trees]
            trees = below
        return alone + [(f, True) for f in trees]

    def files(self, folders: list[tuple[str, bool]]) -> Iterator[tuple[str, os.DirEntry]]:
        for top, deep in folders:
            stack = [(top, self.rules_above(top))]
            while stack:
                folder, above = stack.pop()
                rules = self.with_own(above, folder)
                for path, is_dir, entry in self.entries(folder, rules):
                    if is_dir and deep:
                        stack.append((path, rules))
                    elif not is_dir and entry.is_file(follow_symlinks=False):
                        yield path, entry


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path") or ""
        self.no_ignore = options.get("noignore", "false").lower() == "true"
        self.wanted = int(options.get("parts", PARTS))
        self.names: dict[str, set[str]] = {}
        self.low, self.high = 0, 1 << 63

    def pushFilters(self, filters):
        """Takes equality and lists on ext and kind, and bounds on size; gives back the rest."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, IsNotNull):
                continue  # no column is ever null
            if column in ("ext", "kind") and isinstance(f, (EqualTo, In)):
                given = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names[column] = self.names.get(column, given) & given
            elif column == "size" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo):
                    self.high = min(self.high, f.value)
            elif column == "size" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self):
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root} is no folder")
        roots = Walk(self.root, self.no_ignore).roots(self.wanted)
        return [Part(roots[n :: self.wanted]) for n in range(min(self.wanted, len(roots)))]

    def wants(self, ext: str, kind: str) -> bool:
        return all({"ext": ext, "kind": kind}[c] in given for c, given in self.names.items())

    def read(self, partition):
        kinds = [pa.string()] * 3 + [pa.int64()] * 3
        shape = pa.schema(list(zip(("path", "ext", "kind", "size", "modified", "created"), kinds, strict=True)))
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=shape)

        for path, entry in Walk(self.root, self.no_ignore).files(partition.folders):
            ext = extension(entry.name)
            kind = _KINDS.get(ext[1:].lower(), schema.OTHER)
            if not self.wants(ext, kind):
                continue
            try:
                stat = entry.stat(follow_symlinks=False)
            except FileNotFoundError:
                continue
            if self.low <= stat.st_size <= self.high:
                rows.append((path, ext, kind, stat.st_size, int(stat.st_mtime * 1e6), int(getattr(stat, "st_birthtime", 0.0) * 1e6)))
            if len(rows) >= BATCH:
                yield batch()
                rows = []
        if rows:
            yield batch()


class TreeSource(DataSource):
    """spark.read.format("filetree").option("noIgnore", ...).option("parts", ...).load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> DataSourceReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def tree(spark: SparkSession, root: str, *, no_ignore: bool = False, parts: int = PARTS) -> DataFrame:
    """path, ext, kind, size, modified and created (microseconds) of each file below a folder."""
    workers_find_us(spark)
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("filetree").option("noIgnore", str(no_ignore).lower()).option("parts", str(parts)).load(str(root))


def scan_tree(spark: SparkSession, root: str, *, no_ignore: bool = False, enrich: bool = True, parts: int = PARTS, kind: list[str] | None = None, ext: list[str] | None = None, min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """The 14 columns of files.scan(), by tasks; kind, ext and sizes are filters that reach the walk."""
    found = tree(spark, root, no_ignore=no_ignore, parts=parts)
    for column, given in (("kind", kind), ("ext", ext)):
        if given is not None:
            found = found.where(F.col(column).isin(*given))
    if min_size is not None:
        found = found.where(F.col("size") >= min_size)
    if max_size is not None:
        found = found.where(F.col("size") <= max_size)
    base = classified(found.select("path", "size", "modified", "created")).withColumns({x: F.timestamp_micros(x).cast("timestamp_ntz") for x in ("modified", "created")})
    none = F.lit(None).cast("int")
    if not enrich:
        return base.withColumns({"width": none, "height": none}).select(*schema.FILES.names)
    images = base.where(F.col("kind") == "image").withColumn("_file", F.concat(F.lit(f"{Path(root).resolve()}/"), "path"))
    return image_sizes(images, "_file").select(*schema.FILES.names).unionByName(base.where(F.col("kind") != "image").withColumns({"width": none, "height": none}).select(*schema.FILES.names))
