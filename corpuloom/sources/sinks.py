"""Writers and renderings."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cell, fixed, human_size
from ..operators.context import refs_column


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.option("header", True).option("sep", separator).mode("overwrite").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).mode("overwrite").json(path)


def write_dataset(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """A folder of Parquet shards with a bounded number of rows each."""
    df.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").mode("overwrite").parquet(path)


WRITERS = {"parquet": write_parquet, "csv": write_csv, "tsv": lambda df, path: write_csv(df, path, "\t"), "jsonl": write_jsonl, "dataset": write_dataset}


def resolved_format(flag: str | None, piped: bool | None = None) -> str:
    """The format asked for, else tsv into a pipe and rich on a terminal."""
    piped = not sys.stdout.isatty() if piped is None else piped
    return flag or ("tsv" if piped else "rich")


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row, nulls kept, timestamps with microseconds."""
    shown = [F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name) if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)) else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("json"))


def text_cells(df: DataFrame) -> list[Column]:
    """Every column as text: floats with two decimals, nulls empty."""
    out = []
    for f in df.schema:
        shown = fixed(F.col(f.name), 2) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name).cast("string")
        out.append(F.coalesce(F.when(F.col(f.name).isNotNull(), shown), F.lit("")).alias(f.name))
    return out


def string_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row with every value as text and nulls empty."""
    return df.select(F.to_json(F.struct(*text_cells(df))).alias("json"))


def joined_rows(df: DataFrame, separator: str = "\t") -> DataFrame:
    """One text a row, its cells joined unquoted."""
    return df.select(F.concat_ws(separator, *text_cells(df)).alias("line"))


def markdown_rows(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in text_cells(df))), F.lit(" |")).alias("line"))


def schema_listing(df: DataFrame, descriptions: dict[str, str] | None = None) -> DataFrame:
    """column, type, description and a sample of each column."""
    first = df.first()
    rows = [(f.name, f.dataType.simpleString(), (descriptions or {}).get(f.name, ""), "" if first is None or first[f.name] is None else str(first[f.name])) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "column string, type string, description string, sample string")


def tree(rollup: DataFrame, files: DataFrame) -> dict:
    """Nested name, type, children, files, bytes of a directory roll-up (dir, files, bytes) and its files (path, size)."""
    nodes = {"": {"name": "", "type": "dir", "children": [], "files": 0, "bytes": 0}}
    for r in rollup.orderBy("dir").toLocalIterator():
        node = nodes.setdefault(r["dir"], {"name": r["dir"].rpartition("/")[2], "type": "dir", "children": []})
        node |= {"files": r["files"], "bytes": r["bytes"]}
        if r["dir"]:
            nodes[r["dir"].rpartition("/")[0]]["children"].append(node)
    for r in files.orderBy("path").select("path", "size").toLocalIterator():
        nodes[r["path"].rpartition("/")[0]]["children"].append({"name": r["path"].rpartition("/")[2], "type": "file", "bytes": r["size"]})
    return nodes[""]


def dir_label(name: Column, files: Column, size: Column) -> Column:
    return F.concat(name, F.lit(" ("), files.cast("string"), F.lit(" files, "), human_size(size), F.lit(")"))


def context_table(items: DataFrame, session: str, contents: bool = False) -> str:
    """A markdown table of a session's items (pos, ref_id, role, kind, source) in order, under a heading unless contents are shown.

    With contents items have content, summary and note too; the first that is there fills the last column, cut to 120
    characters.  A session is what one person collected, so it is collected here.
    """
    columns = ["ref_id", "role", "kind", F.replace(F.replace("source", F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")).alias("source")]
    heads = ["ref", "role", "kind", "source"]
    if contents:
        heads.append("content")
        columns.append(F.coalesce(cell(F.coalesce("content", "summary", "note")), F.lit("")).alias("content"))
    rows = items.orderBy("pos").select(*columns).collect()
    title = [] if contents else [f"Context(session={session}, items={len(rows)})", ""]
    if not rows and not contents:
        return "\n".join(title) + "\n"
    lines = [f"| {' | '.join(heads)} |", f"|{'|'.join('-' * (len(h) + 2) for h in heads)}|"]
    return "\n".join(title + lines + [f"| {' | '.join('' if x is None else x for x in r)} |" for r in rows]) + "\n"


def context_tree(items: DataFrame, session: str) -> str:
    """A session's items in order, as branches of a tree, each with its metadata (array of k, v) below it."""
    short = F.when(F.length("source") > 80, F.concat(F.left("source", F.lit(79)), F.lit("…"))).otherwise(F.col("source"))
    rows = items.orderBy("pos").select("ref_id", "role", "kind", short.alias("source"), "metadata").collect()
    lines = [f"Context(session={session}, items={len(rows)})"]
    for n, item in enumerate(rows, 1):
        branch, below = ("└──", "   ") if n == len(rows) else ("├──", "│  ")
        lines.append(f"{branch} [{n}] {item['ref_id']}  {item['role']}  {item['kind']}  {item['source']}")
        entries = item["metadata"] or []
        lines += [f"{below}      {'└─' if m == len(entries) else '├─'} {x['k']}: {x['v']}" for m, x in enumerate(entries, 1)]
    return "\n".join(lines) + "\n"


def with_session(df: DataFrame, refs: DataFrame | None, session: str | None) -> DataFrame:
    """df with session_id and ref_id where a session is given."""
    return df if refs is None else refs_column(df, refs, session)


def to_arrow(df: DataFrame, refs: DataFrame | None = None, session: str | None = None):
    return with_session(df, refs, session).toArrow()


def to_pandas(df: DataFrame, refs: DataFrame | None = None, session: str | None = None):
    return with_session(df, refs, session).toPandas()


def to_polars(df: DataFrame, refs: DataFrame | None = None, session: str | None = None):
    """Needs polars."""
    import polars

    return polars.from_arrow(to_arrow(df, refs, session))
