"""The files table: from a directory, from tables of texts, from piped paths."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..session import arrow_map

MIME_OTHER = "application/octet-stream"


# ---------------------------------------------------------------- classification


def _dimension(groups: dict[str, list[str]]) -> Column:
    return F.create_map(*(F.lit(x) for name, exts in groups.items() for ext in exts for x in (ext, name)))


def bare_ext(ext: Column) -> Column:
    return F.lower(F.regexp_replace(ext, r"^\.", ""))


def kind_of(ext: Column) -> Column:
    """One of nine kinds by extension, whatever its case."""
    return F.coalesce(F.try_element_at(_dimension(schema.KINDS), bare_ext(ext)), F.lit(schema.OTHER))


def media_kind_of(ext: Column, with_code: bool = False) -> Column:
    """The coarser classifier: image, video, audio, document (and code), else text."""
    groups = {"image": schema.MEDIA_IMAGE, "video": schema.MEDIA_VIDEO, "audio": schema.MEDIA_AUDIO, "document": schema.MEDIA_DOCUMENT}
    if with_code:
        groups["code"] = schema.MEDIA_CODE
    return F.coalesce(F.try_element_at(_dimension(groups), bare_ext(ext)), F.lit("text"))


def is_binary(ext: Column) -> Column:
    return kind_of(ext).isin("image", "video", "audio") | bare_ext(ext).isin(*schema.BINARY)


def language_of(ext: Column) -> Column:
    """By the extension as written; null if unknown."""
    return F.try_element_at(_dimension(schema.LANGUAGES), F.regexp_replace(ext, r"^\.", ""))


def mime_of(ext: Column) -> Column:
    """By the platform-independent table of Python's mimetypes."""
    import mimetypes

    known = mimetypes.MimeTypes(filenames=()).types_map[1]
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), F.concat(F.lit("."), bare_ext(ext))), F.lit(MIME_OTHER))


def path_parts(path: Column) -> dict[str, Column]:
    """name, stem, ext (as written, "" if none), parent ("" at the top) and depth of a relative path."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    ext = F.when(ext == ".", "").otherwise(ext)
    return {
        "name": name,
        "stem": F.when(F.length(ext) > 0, F.left(name, F.length(name) - F.length(ext))).otherwise(name),
        "ext": ext,
        "parent": F.regexp_extract(path, r"^(.*)/[^/]*$", 1),
        "depth": F.size(F.split(path, "/")) - 1,
    }


def classified(paths: DataFrame) -> DataFrame:
    """Adds path parts, kind, mime and is_binary to rows with a path."""
    with_parts = paths.withColumns(path_parts(F.col("path")))
    return with_parts.withColumns({"kind": kind_of(F.col("ext")), "mime": mime_of(F.col("ext")), "is_binary": is_binary(F.col("ext"))})


# ---------------------------------------------------------------- directories


def _ignore_regex(pattern: str) -> str:
    """* and ? stay within a name; **/ is any folders, /** all that lies below."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern[i:] == "**" and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]", end + 1
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i])), i + 1
    return out


class IgnoreRules:
    """Ignore patterns of a folder: later ones win, ! takes back, a trailing / means directories.

    A pattern with a slash before its end is matched from the folder, any other at every depth below it.
    """

    def __init__(self, lines: list[str], folder: str = ""):
        self.base, self.rules = f"{folder}/" if folder else "", []
        for line in lines:
            line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r\n"))
            if line and not line.startswith("#"):
                keep = line.startswith("!")
                line = line.removeprefix("!")
                rooted = "/" in line.rstrip("/")
                regex = re.compile(("" if rooted else "(?:.*/)?") + _ignore_regex(line.strip("/")), re.S)
                self.rules.append((regex, line.endswith("/"), keep))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """Whether the last rule that fits ignores path (from the root); None if none fits."""
        out, below = None, path.removeprefix(self.base)
        for regex, dirs_only, keep in self.rules:
            if (is_dir or not dirs_only) and regex.fullmatch(below):
                out = not keep
        return out


def _read_rules(path: Path, folder: str = "") -> list[IgnoreRules]:
    return [IgnoreRules(path.read_text(errors="replace").splitlines(), folder)] if path.is_file() else []


def _walk(root: Path, no_ignore: bool) -> Iterator[tuple[str, int, float, float]]:
    """Regular files below root, hidden ones too; links are not followed.

    Rules come from the user's own ignore file, the repository's exclude file, and .gitignore and .ignore of
    each folder; the innermost that says something decides.
    """
    outer: list[IgnoreRules] = []
    if not no_ignore:
        home = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config")
        outer = [*_read_rules(home / "git" / "ignore"), *_read_rules(root / ".git" / "info" / "exclude")]
    stack: list[tuple[str, list[IgnoreRules]]] = [("", outer)]
    while stack:
        folder, rules = stack.pop()
        here = root / folder
        if not no_ignore:
            rules = [*rules, *_read_rules(here / ".gitignore", folder), *_read_rules(here / ".ignore", folder)]
        for entry in os.scandir(here):
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.is_symlink():
                continue
            is_dir = entry.is_dir(follow_symlinks=False)
            if not no_ignore and (entry.name == ".git" or next((v for r in reversed(rules) if (v := r.verdict(path, is_dir)) is not None), False)):
                continue
            if is_dir:
                stack.append((path, rules))
            elif entry.is_file(follow_symlinks=False):
                stat = entry.stat(follow_symlinks=False)
                yield path, stat.st_size, stat.st_mtime, getattr(stat, "st_birthtime", 0.0)


def scan(spark: SparkSession, root: str, *, no_ignore: bool = False, enrich: bool = True) -> DataFrame:
    """The 14 columns of each file below a local directory, honouring its ignore files.

    enrich: reads image headers, in tasks, for width and height.
    """
    rows = [(p, size, int(m * 1e6), int(b * 1e6)) for p, size, m, b in _walk(Path(root), no_ignore)]
    found = spark.createDataFrame(rows, "path string, size bigint, modified bigint, created bigint")
    base = classified(found).withColumns({x: F.timestamp_micros(x).cast("timestamp_ntz") for x in ("modified", "created")})
    none = F.lit(None).cast("int")
    if not enrich:
        return base.withColumns({"width": none, "height": none}).select(*schema.FILES.names)
    images = base.where(F.col("kind") == "image").withColumn("_file", F.concat(F.lit(f"{Path(root).resolve()}/"), "path"))
    return image_sizes(images, "_file").select(*schema.FILES.names).unionByName(base.where(F.col("kind") != "image").withColumns({"width": none, "height": none}).select(*schema.FILES.names))


def scan_store(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """As scan(), for directories in any file system that Spark reads; no ignore files, created is 0."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    listed = reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("modified"))
    prefix = f"^.*?{root.rstrip('/').split(':', 1)[-1].lstrip('/')}/"
    rows = listed.withColumn("path", F.regexp_replace("path", prefix, "")).withColumn("created", F.timestamp_micros(F.lit(0).cast("bigint")).cast("timestamp_ntz"))
    none = F.lit(None).cast("int")
    return classified(rows).withColumns({"width": none, "height": none}).select(*schema.FILES.names)


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG, GIF, BMP or JPEG header; None if it is none of them or is broken."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            return width, abs(height)
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(data) and data[at] == 0xFF:
                marker = data[at + 1]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return width, height
                at += 2 + (0 if marker == 0xFF else struct.unpack(">H", data[at + 2 : at + 4])[0])
    except struct.error:
        pass
    return None


def image_sizes(files: DataFrame, file_column: str, head: int = 1 << 18) -> DataFrame:
    """width and height of each row's file, read in tasks; null if undecodable."""
    names = [x for x in files.columns if x not in ("width", "height")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path in batch[file_column].to_pylist():
                try:
                    with open(path, "rb") as f:
                        sizes.append(image_size(f.read(head)) or (None, None))
                except OSError:
                    sizes.append((None, None))
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in names), pa.array([w for w, _ in sizes], pa.int32()), pa.array([h for _, h in sizes], pa.int32())], [*names, "width", "height"])

    shape = ", ".join(f"`{x}` {files.schema[x].dataType.simpleString()}" for x in names)
    return arrow_map(files.select(*names), read, f"{shape}, width int, height int")


# ---------------------------------------------------------------- tables of texts


def from_documents(documents: DataFrame) -> DataFrame:
    """documents as text files /<source>/<lang>/<doc_id>.txt, with their text."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    rows = documents.select("doc_id", path.alias("path"), F.octet_length("text").cast("bigint").alias("size"), "text")
    return classified(rows)


def from_pages(pages: DataFrame) -> DataFrame:
    """pages as files <host>/<page_id>.html, with their html as text."""
    host = F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), F.lit(""))
    path = F.concat_ws("/", host, F.concat(F.col("page_id").cast("string"), F.lit(".html")))
    return classified(pages.select("page_id", path.alias("path"), F.octet_length("html").cast("bigint").alias("size"), F.col("html").alias("text")))


# ---------------------------------------------------------------- lists of paths

# Words that are a header in a piped table.
HEADERS = {"path", "uri", "name", "file", "kind", "size", "ext", "mime", "column", "type", "table"}


def piped_paths(text: str) -> list[str]:
    """Paths from JSON (strings, or objects with path, uri or name), TSV or CSV (last field) or bare lines."""
    stripped = text.strip()
    if not stripped:
        return []
    if stripped[0] in "[{":
        try:
            items = json.loads(stripped)
        except json.JSONDecodeError:
            items = None
        if items is not None:
            items = items if isinstance(items, list) else [items]
            picked = (x if isinstance(x, str) else next((x[k] for k in ("path", "uri", "name") if x.get(k)), None) for x in items)
            return [x for x in picked if x]
    out = []
    for line in stripped.splitlines():
        fields = line.split("\t") if "\t" in line else next(csv.reader(io.StringIO(line)), []) if "," in line else [line]
        last = fields[-1].strip() if fields else ""
        if last and last.lower() not in HEADERS:
            out.append(last)
    return out


def restricted(files: DataFrame, paths: list[str], column: str = "path") -> DataFrame:
    """The files whose path is in the list."""
    wanted = files.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(paths)], "_wanted string")
    return files.join(wanted, files[column] == wanted["_wanted"], "left_semi")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """uri, mtime_us and size of an index manifest, a JSON object by path."""
    entries = "map<string,struct<mtime_us:bigint,size:bigint>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", entries)).alias("uri", "x"))
    return raw.select("uri", "x.mtime_us", "x.size")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; a table without rows is an error."""
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df
