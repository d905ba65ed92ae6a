"""Encoders as a SQL table function.

    SELECT uri, message, part, type, text
    FROM encode(TABLE(pages), 'document/pages', map('pages_per_message', '4'))

    SELECT uri, message, part, type, text
    FROM encode_by(TABLE(pages) PARTITION BY (uri) ORDER BY (ordinal), 'document/pages', map('pages_per_message', '4'))

The table needs columns uri and data (ordinal too, for encoders of rows in order); other
columns are not read.  encode() asks for its rows by uri and in order itself; encode_by()
takes them as the call says, and fails on rows of several uris or out of order.  Rows come
one at a time and messages leave as soon as they are full, so a document of any number of
pages needs no more than one message's memory.  What the call gives is checked when the
query is analysed.

Defined results: null data is empty text; options are strings, and null without any; repeated
rows are rows by themselves; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn, udtf

from ..session import workers_find_us
from . import encoders

Part = tuple[int, int, str, str]
SHAPE = T.StructType([T.StructField("uri", T.StringType()), T.StructField("message", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])


class Pages:
    """Rows of a uri are pages, so many to a message."""

    ordered = True

    def __init__(self, uri: str, options: dict[str, str]):
        self.size, self.page, self.held = int(options.get("pages_per_message", 4)), 0, []
        if self.size < 1:
            raise ValueError("pages_per_message is at least 1")

    def row(self, data: object) -> Iterator[Part]:
        self.page += 1
        self.held.append(f"--- Page {self.page} ---\n{'' if data is None else data}")
        if len(self.held) == self.size:
            yield from self.end()

    def end(self) -> Iterator[Part]:
        if self.held:
            yield (self.page - 1) // self.size, 0, "text", "\n\n".join(self.held)
            self.held = []


def each_row(encode: encoders.Encoder) -> type:
    """An encoder of single values: messages of a uri's later rows are numbered on."""

    class EachRow:
        ordered = False

        def __init__(self, uri: str, options: dict[str, str]):
            self.uri, self.options, self.first = uri, options, 0

        def row(self, data: object) -> Iterator[Part]:
            last = -1
            for message, part, kind, text in encode(self.uri, data, self.options):
                last = max(last, message)
                yield self.first + message, part, kind, text
            self.first += last + 1

        def end(self) -> Iterator[Part]:
            return iter(())

    return EachRow


def known() -> dict[str, type]:
    """All encoders that can be called by name: of rows in order, and the registered ones of single values."""
    return {"document/pages": Pages} | {name: each_row(encoders._REGISTRY[name]) for name in encoders.names()}


def table_function(of: dict[str, Callable], divides: bool = True) -> type:
    """The function over these encoders, which are sent to tasks with it; divides: it asks for rows by uri itself."""

    class Encode:
        def __init__(self):
            self.uri, self.running, self.last = None, None, None

        @staticmethod
        def analyze(rows: AnalyzeArgument, encoder: AnalyzeArgument, options: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument is a table: encode(TABLE(t) PARTITION BY uri, ...)")
            if not encoder.isConstantExpression or encoder.value not in of:
                raise ValueError(f"the second argument is one of {sorted(of)}")
            needed = ["uri", "data"] + ["ordinal"] * of[encoder.value].ordered
            missing = [c for c in needed if c not in rows.dataType.fieldNames()]
            if missing:
                raise ValueError(f"the table has no column {', '.join(missing)}")
            if options is not None and options.value is not None and not isinstance(options.value, dict):
                raise ValueError("options are a map of strings")
            if not divides:
                return AnalyzeResult(SHAPE)
            return AnalyzeResult(SHAPE, partitionBy=[PartitioningColumn("uri")], orderBy=[OrderingColumn("ordinal")] if of[encoder.value].ordered else [], select=[SelectedColumn(c) for c in needed])

        def eval(self, row, encoder, options=None):
            if self.running is None:
                self.uri, self.running = row["uri"], of[encoder](row["uri"], {k: v for k, v in (options or {}).items()})
            if not divides:
                if row["uri"] != self.uri:
                    raise ValueError("rows of several uris: write PARTITION BY (uri) behind the table")
                if of[encoder].ordered:
                    if self.last is not None and row["ordinal"] < self.last:
                        raise ValueError("rows out of order: write ORDER BY (ordinal) behind the table")
                    self.last = row["ordinal"]
            for part in self.running.row(row["data"]):
                yield self.uri, *part

        def terminate(self):
            if self.running is not None:
                for part in self.running.end():
                    yield self.uri, *part

    return Encode


def register(spark: SparkSession, name: str = "encode", of: dict[str, Callable] | None = None) -> None:
    """Makes both functions known to SQL; encoders that are registered later need another call."""
    workers_find_us(spark)
    of = known() if of is None else of
    spark.udtf.register(name, udtf(table_function(of)))
    spark.udtf.register(f"{name}_by", udtf(table_function(of, divides=False)))
