"""Encoders called from SQL."""

import pytest

from corpuloom.plans import encoders, table_function


@pytest.fixture(scope="module")
def sql(spark):
    def halves(uri, data, options):  # of the caller's own code, which tasks cannot import
        data = data or ""
        for n, part in enumerate((data[: len(data) // 2], data[len(data) // 2 :])):
            yield n, 0, "text", part + options.get("end", "")

    encoders.register("text", "halves")(halves)
    table_function.register(spark)
    rows = [("a", i, f"p{i}", 1) for i in (3, 0, 6, 1, 5, 2, 4)] + [("b", 0, None, 2), (None, 2, "z", 0), (None, 1, "y", 0)]
    spark.createDataFrame(rows, "uri string, ordinal int, data string, message int").repartition(3).createOrReplaceTempView("pages_t")
    yield lambda q: sorted(map(tuple, spark.sql(q).collect()), key=repr)
    spark.catalog.dropTempView("pages_t")
    encoders._REGISTRY.pop("text/halves")


def pages(uri, values, size):
    marked = [f"--- Page {i + 1} ---\n{v}" for i, v in enumerate(values)]
    return [(uri, m, 0, "text", "\n\n".join(marked[m * size : (m + 1) * size])) for m in range(-(-len(marked) // size))]


@pytest.mark.parametrize("size", [1, 3, 7, 50])
@pytest.mark.parametrize("call", ["encode(TABLE(pages_t), {})", "encode_by(TABLE(pages_t) PARTITION BY (uri) ORDER BY (ordinal), {})"])
def test_pages_to_messages(sql, size, call):
    got = sql(f"SELECT uri, message, part, type, text FROM {call.format(f"'document/pages', map('pages_per_message', '{size}')")}")
    want = pages("a", [f"p{i}" for i in range(7)], size) + pages("b", [""], size) + pages(None, ["y", "z"], size)
    assert got == sorted(want, key=repr)


def test_encoders_of_values_number_messages_on(sql):
    got = sql("SELECT * FROM encode(TABLE(SELECT uri, data FROM pages_t WHERE uri = 'b'), 'text/halves', map('end', '!'))")
    assert got == [("b", 0, 0, "text", "!"), ("b", 1, 0, "text", "!")]
    many = sql("SELECT message, count(*) FROM encode(TABLE(SELECT uri, data FROM pages_t WHERE uri = 'a'), 'text/halves') GROUP BY message")
    assert many == [(n, 1) for n in range(14)] or sorted(many) == [(n, 1) for n in range(14)]
    assert sql("SELECT * FROM encode(TABLE(SELECT uri, data FROM pages_t WHERE uri = 'none'), 'text/plain')") == []


@pytest.mark.parametrize(
    "call, message",
    [
        ("encode(TABLE(pages_t), 'nope')", "second argument is one of"),
        ("encode(TABLE(SELECT uri FROM pages_t), 'text/plain')", "no column data"),
        ("encode(TABLE(SELECT uri, data FROM pages_t), 'document/pages')", "no column ordinal"),
        ("encode('pages_t', 'text/plain')", "first argument is a table"),
        ("encode(TABLE(pages_t), 'text/plain', 'x')", "map of strings"),
        ("encode_by(TABLE(pages_t) WITH SINGLE PARTITION, 'text/plain')", "PARTITION BY"),
        ("encode_by(TABLE(SELECT * FROM pages_t WHERE uri = 'a') PARTITION BY (uri) ORDER BY (ordinal DESC), 'document/pages')", "ORDER BY"),
    ],
)
def test_calls_that_are_refused(sql, call, message):
    with pytest.raises(Exception, match=message):
        sql(f"SELECT * FROM {call}")


def test_plan_partitions_by_uri(spark, sql):
    plan = spark.sql("SELECT * FROM encode(TABLE(pages_t), 'document/pages')")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in plan and "Sort" in plan and "UDTF" in plan
