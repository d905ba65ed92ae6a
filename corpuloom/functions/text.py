"""Column functions over text: lines, words, tokens, sizes, matching, snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What Python's str.splitlines() takes for a line end.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def line_count(text: Column) -> Column:
    """Lines ended by a newline, and a last unended one; an empty text has none."""
    ended = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (ended + ((text != "") & ~F.endswith(text, F.lit("\n"))).cast("int")).cast("bigint")


def document_line_count(text: Column) -> Column:
    """line_count(), at least 1."""
    return F.greatest(F.lit(1).cast("bigint"), line_count(text))


def piped_line_count(text: Column, kind: Column) -> Column:
    """Newlines, at least 1; binary kinds have none; documents as document_line_count()."""
    ended = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")
    return F.when(kind.isin("image", "video", "audio"), F.lit(0).cast("bigint")).when(kind == "document", document_line_count(text)).otherwise(F.greatest(F.lit(1).cast("bigint"), ended))


def word_count(text: Column) -> Column:
    """Runs of what is not Unicode white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("bigint")


def byte_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("bigint")


def char_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")


def density(tokens: Column, size: Column) -> Column:
    """Tokens per MiB, rounded half to even; null without bytes."""
    return F.when(size > 0, F.bround(tokens / (size / F.lit(1048576.0))).cast("bigint"))


def split_lines(text: Column) -> Column:
    """Lines as str.splitlines() gives them: no empty line after the last line end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def fold(text: Column) -> Column:
    """ASCII letters in lower case, as SQL's NOCASE compares."""
    return F.translate(text, UPPER, LOWER)


def smart_case(pattern: str, ignore_case: bool = False) -> str:
    """The pattern, case-insensitive if asked for or if it has no capital outside of escapes."""
    has_capital = any(c.isupper() for c in re.sub(r"\\.", "", pattern))
    return pattern if has_capital and not ignore_case else f"(?i){pattern}"


def name_matches(name: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Regex search if the pattern is one, else a case-insensitive substring."""
    try:
        re.compile(pattern)
    except re.error:
        return F.contains(F.lower(name), F.lit(pattern.lower()))
    return name.rlike(f"(?i){pattern}" if ignore_case else pattern)


def fixed(value: Column, digits: int) -> Column:
    """Text with so many decimals, ties to even as C's printf has them (Java's go up)."""
    return F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits))


def human_size(size: Column) -> Column:
    """1536 as 1.5 KB; whole bytes below 1024."""
    out = F.when(size < 1024, F.concat(F.floor(size).cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = out.when(size < 1024 ** (k + 1), F.concat(fixed(size / float(1024**k), 1), F.lit(f" {unit}")))
    return out.otherwise(F.concat(fixed(size / float(1024**5), 1), F.lit(" PB")))


def human_count(n: Column) -> Column:
    """1500 as 1.5K, up to B (with two decimals)."""
    return (
        F.when(n >= 10**9, F.concat(fixed(n / 1e9, 2), F.lit("B")))
        .when(n >= 10**6, F.concat(fixed(n / 1e6, 1), F.lit("M")))
        .when(n >= 10**3, F.concat(fixed(n / 1e3, 1), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def clock(seconds: Column) -> Column:
    """75.5 as 1m 15.5s."""
    return F.format_string("%dm %.1fs", F.floor(seconds / 60).cast("bigint"), seconds - F.floor(seconds / 60) * 60)


def size_literal(text: str | int) -> int:
    """10MB as 10485760; units of 1024, any case, fractions allowed."""
    if isinstance(text, int):
        return text
    found = re.fullmatch(r"\s*([0-9.]+)\s*([KMGT]?)B?\s*", text.upper())
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(float(found[1]) * 1024 ** " KMGT".index(found[2] or " "))


def snippet(text: Column, pattern: str, context: int = 40) -> Column:
    """The first match and context characters around it, with ... where cut; without one, the beginning and end."""
    raw = F.replace(text, F.lit("\n"), F.lit(" "))
    at = F.regexp_instr(raw, F.lit(f"({pattern})"))
    length = F.length(F.regexp_substr(raw, F.lit(pattern)))
    begin = F.greatest(F.lit(0), at - 1 - context)
    end = F.least(F.length(raw), at - 1 + length + context)
    found = F.concat(F.when(begin > 0, "...").otherwise(""), F.substring(raw, begin + 1, end - begin), F.when(end < F.length(raw), "...").otherwise(""))
    ends = F.when(F.length(raw) > 140, F.concat(F.left(raw, F.lit(90)), F.lit("..."), F.right(raw, F.lit(50)))).otherwise(F.left(raw, F.lit(140)))
    return F.when(at > 0, found).otherwise(ends)


def cell(text: Column, width: int = 120) -> Column:
    """A markdown table cell: no line ends, bars escaped, cut with an ellipsis."""
    flat = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(flat) > width, F.concat(F.left(flat, F.lit(width - 1)), F.lit("…"))).otherwise(flat)


def preview(text: Column, n: int = 500) -> Column:
    return F.left(text, F.lit(n))


def some_lines(text: Column, n: int) -> Column:
    """The first n lines, or for a negative n the last -n; line ends become \\n."""
    lines = lambda a: F.slice(a, 1, n) if n >= 0 else F.slice(a, F.greatest(F.lit(1), F.size(a) + 1 + n), -n)
    return F.element_at(F.transform(F.array(split_lines(text)), lambda a: F.array_join(lines(a), "\n")), 1)
