"""Regex lines, substrings of chunks, exact nearest neighbours, and their merge."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, smart_case, snippet, split_lines
from ..session import arrow_map
from .chunks import chunked
from .nearpairs import by_key, codes, matrix, nearest_pairs

#: Queries, and rows, that meet as one pair of matrices.
QUERY_BLOCK, ROW_BLOCK = 2048, 2048
#: How often an embedding is tried.
ATTEMPTS = 3


def grep(files: DataFrame, pattern: str, *, ignore_case: bool = False, smart: bool = True, context: int = 0) -> DataFrame:
    """path, line_number, line (and context, the lines around it) of each line that matches.

    Lines are matched once, before they are exploded; context comes from the same line array.
    """
    regex = smart_case(pattern, ignore_case) if smart else f"(?i){pattern}" if ignore_case else pattern
    lines = split_lines(F.col("text"))
    # The lines are an outer lambda's argument, so that a text is split once.
    each = F.transform(F.array(lines), lambda a: F.struct(a.alias("lines"), F.filter(F.transform(a, lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: x["line"].rlike(regex)).alias("found")))
    split = files.select("path", F.element_at(each, 1).alias("_s"))
    rows = split.select("path", *([F.col("_s.lines").alias("lines")] if context else []), F.explode("_s.found").alias("_f")).select("path", *(["lines"] if context else []), "_f.at", "_f.line")
    columns = ["path", (F.col("at") + 1).alias("line_number"), "line"]
    if context:
        first = F.greatest(F.lit(1), F.col("at") + 1 - context)
        columns.append(F.slice("lines", first, F.col("at") + 1 + context - first + 1).alias("context"))
    return rows.select(*columns)


def grep_counts(files: DataFrame, pattern: str, **options) -> DataFrame:
    """path and the number of its matching lines; counted within the row, without a shuffle."""
    regex = smart_case(pattern, options.get("ignore_case", False))
    n = F.size(F.filter(split_lines(F.col("text")), lambda x: x.rlike(regex)))
    return files.select("path", n.cast("bigint").alias("matches")).where("matches > 0")


def substring_search(chunks: DataFrame, query: str, *, uri: str | None = None, prefix: str | None = None, loose: bool = False, kinds: DataFrame | None = None, kind: list[str] | None = None, ext: str | None = None, limit: int | None = None) -> DataFrame:
    """path, index, rank, match of the chunks that hold the query, ASCII case aside; a blank query finds nothing.

    kinds: (uri, kind), to filter by kind.  Results are ordered by path, mode and index.
    """
    found = chunks.where(F.lit(bool(query.strip())) & F.contains(fold(F.col("chunk_text")), fold(F.lit(query))))
    if uri is not None:
        found = found.where(F.col("file_uri") == uri)
    if prefix is not None:
        found = found.where(F.col("file_uri").startswith(prefix if loose else prefix.rstrip("/") + "/"))
    if ext is not None:
        found = found.where(F.lower("file_uri").endswith(ext.lower()))
    if kind is not None and kinds is not None:
        found = found.join(kinds.where(F.col("kind").isin(*kind)), F.col("file_uri") == F.col("uri"), "left_semi")
    if limit is not None:
        found = found.orderBy("file_uri", "mode", "chunk_idx").limit(limit)
    return found.select(F.col("file_uri").alias("path"), F.col("chunk_idx").alias("index"), F.lit(0.0).alias("rank"), F.col("chunk_text").alias("match"))


def hit_lines(hits: DataFrame, pattern: str) -> DataFrame:
    """Chunk hits as path, line_number (the chunk's index) and a snippet line."""
    return hits.select("path", F.col("index").alias("line_number"), snippet(F.col("match"), pattern).alias("line"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean, in the JVM."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda t, x: t + x))


def nearest(vectors: DataFrame, query: list[float], k: int, *, where: Column | None = None, cutoff: float | None = None, digits: int | None = None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest rows by distance, ties by key; where is applied before the k are taken."""
    at = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors.where(where) if where is not None else vectors
    rows = rows.withColumn("distance", distance(F.col(column), at))
    if cutoff is not None:
        rows = rows.where(F.col("distance") <= cutoff)
    top = rows.orderBy("distance", key).limit(k)
    return top.withColumn("distance", F.round("distance", digits)) if digits is not None else top


def _packed(rows: DataFrame, key: str, size: int, parts: int, name: str) -> DataFrame:
    """Rows (key, embedding) in matrices of at most size rows of one width, by key; rows without a vector have width -1."""
    kind = rows.schema[key].dataType.simpleString()
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull())
    slim = rows.select(F.col(key).alias("key"), F.when(whole, F.col("embedding").cast("array<double>")).alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"]
            widths = np.where(x.is_null().to_numpy(zero_copy_only=False), -1, x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            order = by_key(batch["key"])
            for width in np.unique(widths):
                mine = order[widths[order] == width]
                for lo in range(0, len(mine), size):
                    at = pa.array(mine[lo : lo + size])
                    values = b"" if width < 0 else matrix(x.take(at), int(width)).tobytes() if width else b""
                    yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([batch["key"].take(at)], pa.list_(batch["key"].type)), pa.array([values], pa.binary())], [f"{name}_width", f"{name}_keys", f"{name}_x"])

    return arrow_map(slim, pack, f"{name}_width int, {name}_keys array<{kind}>, {name}_x binary").repartition(parts)


def nearest_to_rows(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """query, key, distance and rank of the k nearest of every query row, itself aside; rows without a vector come last.

    Every query meets every row: both are packed into matrices, every matrix of queries meets every one of rows
    in some task, and a pair of them leaves k rows a query.  Nothing of it passes the driver, and a task holds
    one pair of matrices at a time.
    """
    kind = vectors.schema[key].dataType.simpleString()
    parts = max(2, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked, met = _packed(queries, key, QUERY_BLOCK, 2, "q"), _packed(vectors, key, ROW_BLOCK, parts, "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_keys, v_keys = batch["q_keys"][i].values, batch["v_keys"][i].values
                mine, theirs = codes(q_keys, v_keys)
                barred = mine[:, None] == theirs[None, :]
                width = batch["q_width"][i].as_py()
                if width < 0 or width != batch["v_width"][i].as_py():
                    free = ~barred & (np.cumsum(~barred, 1) <= k)
                    row, col = np.nonzero(free)
                    far = pa.nulls(len(row), pa.float64())
                else:
                    q, v = (np.frombuffer(batch[f"{s}_x"][i].as_buffer(), np.float64).reshape(n, width) for s, n in (("q", len(q_keys)), ("v", len(v_keys))))
                    row, col, far = nearest_pairs(q, v, barred, k)
                    far = pa.array(far)
                yield pa.RecordBatch.from_arrays([q_keys.take(pa.array(row)), v_keys.take(pa.array(col)), far], ["query", key, "distance"])

    found = arrow_map(met.hint("shuffle_replicate_nl").crossJoin(asked), meet, f"query {kind}, {key} {kind}, distance double")
    # Spark keeps k of each query in each task before it shuffles them.
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def merged(regex_hits: DataFrame, chunk_hits: DataFrame, semantic_hits: DataFrame, limit: int = 5) -> DataFrame:
    """Regex lines, then at most limit substring and semantic hits; a chunk is listed once, by its first source.

    Inputs: path, line_number, line; source_rank 0, 1, 2 and order tell where a row came from.
    """
    lines = regex_hits.select("path", "line_number", "line", F.lit(0).alias("source_rank"))
    best = Window.partitionBy("path", "line_number").orderBy("source_rank")
    some = chunk_hits.orderBy("path", "line_number").limit(limit).select("path", "line_number", "line", F.lit(1).alias("source_rank"))
    near = semantic_hits.orderBy("distance", "path", "line_number").limit(limit).select("path", "line_number", "line", F.lit(2).alias("source_rank"))
    chunks = some.unionByName(near).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return lines.unionByName(chunks)


def index_status(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """uri and status: indexed (a chunk has a vector), chunked_only or unprocessed."""
    has_vector = chunks.join(vectors.select(F.col("chunk_id").alias("id")), "id", "left_semi").select(F.col("file_uri").alias("uri")).distinct().withColumn("_v", F.lit(True))
    has_chunk = chunks.select(F.col("file_uri").alias("uri")).distinct().withColumn("_c", F.lit(True))
    both = files.select("uri").join(has_chunk, "uri", "left").join(has_vector, "uri", "left")
    return both.select("uri", F.when(F.col("_v"), "indexed").when(F.col("_c"), "chunked_only").otherwise("unprocessed").alias("status"))


def _embedded(texts: list[str], embed, delay: float) -> list[list[float]]:
    """embed(texts), tried ATTEMPTS times, each wait twice as long as the one before."""
    for attempt in range(ATTEMPTS):
        try:
            vectors = embed(texts)
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            return vectors
        except Exception:
            if attempt == ATTEMPTS - 1:
                raise
            time.sleep(delay * 2**attempt)
    raise AssertionError("unreachable")


def embedded(chunks: DataFrame, embed, delay: float = 1.0) -> DataFrame:
    """chunk_id and embedding of each chunk; embed takes and returns lists, a batch at a time, and is retried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _embedded(batch["chunk_text"].to_pylist(), embed, delay)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(vectors, pa.list_(pa.float32()))], ["chunk_id", "embedding"])

    return arrow_map(chunks.select("id", "chunk_text"), run, "chunk_id bigint, embedding array<float>")


def missing_chunks(files: DataFrame, chunks: DataFrame, vectors: DataFrame, text: str = "text") -> DataFrame:
    """file_uri, id, chunk_idx and chunk_text of all that has no vector in files that are not indexed.

    Stored chunks of files that are only chunked keep their id; files without chunks (uri, text) are chunked
    now, and their chunks have no id yet.  Files without text give nothing.
    """
    status = index_status(files, chunks, vectors)
    waiting = status.where("status = 'chunked_only'").select(F.col("uri").alias("file_uri"))
    stored = chunks.join(waiting, "file_uri", "left_semi").select("file_uri", "id", "chunk_idx", "chunk_text")
    new = files.select("uri", F.col(text).alias("_text")).join(status.where("status = 'unprocessed'").select("uri"), "uri", "left_semi")
    return stored.unionByName(chunked(new, "_text").select(F.col("uri").alias("file_uri"), F.lit(None).cast("bigint").alias("id"), F.col("chunk_idx").cast("int"), "chunk_text"))


def embedded_partly(chunks: DataFrame, embed, delay: float = 1.0) -> DataFrame:
    """Chunks with embedding and error: a batch that fails is tried text by text, and a text that fails has no embedding but an error."""
    names = ["file_uri", "id", "chunk_idx", "chunk_text"]

    def each(texts: list[str]) -> Iterator[tuple[list[float] | None, str | None]]:
        try:
            yield from ((v, None) for v in _embedded(texts, embed, delay))
            return
        except Exception as e:
            if len(texts) == 1:
                yield None, str(e)
                return
        for one in texts:
            yield from each([one])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(each(batch["chunk_text"].to_pylist())) if batch.num_rows else []
            made = [pa.array([v for v, _ in got], pa.list_(pa.float32())), pa.array([e for _, e in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *made], [*names, "embedding", "error"])

    return arrow_map(chunks.select(*names), run, "file_uri string, id bigint, chunk_idx int, chunk_text string, embedding array<float>, error string")


def indexed_files(embedded: DataFrame) -> DataFrame:
    """file_uri, n_embedded, n_failed and indexed (nothing failed) of each file of embedded_partly."""
    failed = F.count("error")
    return embedded.groupBy("file_uri").agg(F.count("embedding").alias("n_embedded"), failed.alias("n_failed"), (failed == 0).alias("indexed"))
