"""SQL over the catalog: views by name, and the few words that differ from SQLite's."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_QUOTED = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`)")
_REWRITES = (
    (re.compile(r"\bGROUP_CONCAT\s*\(", re.I), "listagg("),
    (re.compile(r"\bIFNULL\s*\(", re.I), "coalesce("),
)
_GLOB = re.compile(r"\bGLOB(\s*)$", re.I)


def glob_regex(pattern: str) -> str:
    """* is any text, ? a character, [..] and [^..] one of a class; the whole value is matched, and case counts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2)) if c == "[" else -1
        if end > 0:
            inner = pattern[i + 1 : end]
            out.append("[" + ("^" if inner.startswith("^") else "") + re.sub(r"([\\\[\]&^])", r"\\\1", inner.removeprefix("^")) + "]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def translated(query: str) -> str:
    """SQLite's function names in Spark's; quoted text stays."""
    found = re.fullmatch(r"\s*PRAGMA\s+table_info\s*\(\s*['\"]?(\w+)['\"]?\s*\)\s*;?\s*", query, re.I)
    if found:
        return f"DESCRIBE {found[1]}"
    parts = _QUOTED.split(query.strip().rstrip(";"))
    for i in range(0, len(parts), 2):
        if _GLOB.search(parts[i]) and i + 1 < len(parts) and parts[i + 1][0] == "'":
            regex = glob_regex(parts[i + 1][1:-1].replace("''", "'"))
            parts[i], parts[i + 1] = _GLOB.sub(r"RLIKE\1", parts[i]), "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if re.search(r"\bGLOB\b", parts[i], re.I):
            raise ValueError("GLOB takes a quoted pattern")
        for pattern, new in _REWRITES:
            parts[i] = pattern.sub(new, parts[i])
    return "".join(parts)


def sql(spark: SparkSession, query: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """The query over views (and whatever the session knows); joins across views and scopes compose."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(translated(query))
