"""Files, extractions, chunks and vectors in bucketed versions, and the changes that make new ones.

A change rewrites the buckets it touches and is seen whole, in all tables at once, or not
at all (see buckets.py).  Files lie by uri, extractions by id, chunks by their file and
vectors by their chunk, so what hangs on a file is rewritten where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import extraction_id
from ..lineage import cut
from ..schema import CONTENT_COLUMNS, KEYS, TABLES
from .buckets import KEEP, Buckets, Table
from .chunks import chunk_count, chunked, reassembled
from .sift import sifted

PLACES = {"files": "uri", "extractions": "id", "chunks": "file_uri", "chunks_vec": "chunk_id"}


class Store(Buckets):
    """Tables files, extractions, chunks and chunks_vec below a folder of any file system."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, keep: int = KEEP):
        super().__init__(spark, root, {t: Table(TABLES[t], KEYS[t], PLACES[t]) for t in TABLES}, buckets, keep)

    def register(self) -> None:
        """Temporary views of all tables, for SQL."""
        for table in TABLES:
            self.read(table).createOrReplaceTempView(table)

    # ------------------------------------------------------------ changes

    def upsert_files(self, scanned: DataFrame) -> int:
        base, buckets = self.manifest(), self.touched("files", scanned)
        stored = self.read("files", buckets=buckets, of=base)
        # Where nothing is stored yet, nothing has to meet: rows are written where they lie.
        new = not any(b in base.tables.get("files", {}) for b in buckets)
        now = scanned.select(*(F.col(f.name) if f.name in scanned.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in stored.schema)) if new else upserted(stored, scanned)
        return self.commit(base, {"files": self.staged("files", now, buckets, meet=not new)})

    def ensure_metadata(self, scanned: DataFrame, uris: DataFrame) -> int:
        base, buckets = self.manifest(), self.touched("files", uris)
        return self.commit(base, {"files": self.staged("files", ensured(self.read("files", buckets=buckets, of=base), scanned, uris), buckets)})

    def _without_vectors(self, base, gone: DataFrame) -> dict[int, str | None]:
        """chunks_vec without the vectors of gone (chunk_id)."""
        buckets = self.touched("chunks_vec", gone)
        return self.staged("chunks_vec", self.read("chunks_vec", buckets=buckets, of=base).join(gone, "chunk_id", "left_anti"), buckets)

    def delete_files(self, uris: DataFrame) -> int:
        """Removes files (uri) with all that hangs on them."""
        base = self.manifest()
        uris = uris.select("uri").distinct()
        by_uri = uris.withColumnRenamed("uri", "file_uri")
        files, places = self.touched("files", uris), self.touched("chunks", by_uri)
        ids = self.read("extractions", of=base).join(by_uri, "file_uri", "left_semi").select("id")
        extractions = self.touched("extractions", ids)
        chunks = self.read("chunks", buckets=places, of=base)
        gone = chunks.join(by_uri, "file_uri", "left_semi").select(F.col("id").alias("chunk_id"))
        staged = {"chunks_vec": self._without_vectors(base, gone)}
        staged["chunks"] = self.staged("chunks", chunks.join(by_uri, "file_uri", "left_anti"), places)
        staged["extractions"] = self.staged("extractions", self.read("extractions", buckets=extractions, of=base).join(by_uri, "file_uri", "left_anti"), extractions)
        staged["files"] = self.staged("files", self.read("files", buckets=files, of=base).join(uris, "uri", "left_anti"), files)
        return self.commit(base, staged)

    def put_extraction(self, rows: DataFrame) -> int:
        """Replaces extractions by id, with their chunks and the chunks' vectors; rows: an extraction and its output.

        Both tiers are stored: the output under the extraction's mode, and as mode metadata the text that the
        store has for the content hash, where it has one.  An extraction of a file that is not stored is an
        error; of rows that share an id, any stays.
        """
        return self.put_kept(cut(rows.dropDuplicates(["id"])))

    def put_kept(self, rows: DataFrame) -> int:
        """put_extraction of rows whose ids differ and that lie in a checkpoint, from which they are written without a move.

        Where nothing is replaced, what the store has stays as it is and the new rows come beside it.
        """
        base = self.manifest()
        by_uri = rows.select(F.col("file_uri").alias("uri"))
        missing = by_uri.join(self.read("files", buckets=self.touched("files", by_uri), of=base), "uri", "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"no stored file {missing[0]['uri']}")
        places = self.touched("extractions", rows)
        extractions = self.read("extractions", buckets=places, of=base)
        # Equal content in another file has the same id, so that what is replaced may lie elsewhere.
        old = extractions.join(rows.select("id"), "id", "left_semi")
        around = self.touched("chunks", rows.select("file_uri").unionByName(old.select("file_uri")))
        chunks = self.read("chunks", buckets=around, of=base)
        gone = chunks.join(rows.select(F.col("id").alias("extraction_id")), "extraction_id", "left_semi").select("id")
        made = self._tiers(rows, base).select(*TABLES["chunks"].names)
        fresh = rows.withColumn("summary", F.coalesce(F.left("output", F.lit(500)), F.lit(""))).select(*TABLES["extractions"].names)
        if self.room(base, "chunks", around) and self.room(base, "extractions", places) and old.isEmpty() and gone.isEmpty():
            return self.commit(base, {"chunks": self.staged("chunks", made, around, meet=False), "extractions": self.staged("extractions", fresh, places, meet=False)}, beside=True)
        return self.commit(
            base,
            {
                "chunks_vec": self._without_vectors(base, gone.select(F.col("id").alias("chunk_id"))),
                "chunks": self.staged("chunks", chunks.join(gone, "id", "left_anti").select(*TABLES["chunks"].names).unionByName(made), around),
                "extractions": self.staged("extractions", replaced(extractions, fresh, "id"), places),
            },
        )

    def _tiers(self, rows: DataFrame, base) -> DataFrame:
        """Chunks of the rows' outputs and of their files' own texts, numbered on from the largest id of base.

        An output is chunked where the checkpoint has it: its chunks' numbers follow from their places there.  A file's
        text moves once, to the extractions of its content; how many chunks it gives is told before by narrow rows.
        """
        from pyspark.sql import Window

        first = self.read("chunks", of=base).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        part, ahead = F.spark_partition_id().alias("_part"), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = lambda of, n: of.select(part, n.alias("_n")).groupBy("_part").agg(F.sum("_n").alias("_n"))
        # A row for each partition of a checkpoint.
        before = lambda counted: F.broadcast(cut(counted).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before")))
        shape = ["extraction_id", "file_uri", "content_hash", "profile", "model", "mode", "created_at", "output"]
        outputs = chunked(rows.withColumnRenamed("id", "extraction_id").select(*shape), "output").withColumns({"_part": F.spark_partition_id(), "_m": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        counts = cut(sizes(rows, chunk_count(F.col("output"))))
        outputs = outputs.join(before(counts), "_part").withColumn("id", F.col("_before") + F.col("_m") + first + 1)
        first += counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        # Which file has a content's text is told by narrow rows.
        files = self.read("files", of=base)
        of = latest_content(files.withColumn("_place", F.struct(F.col("uri").alias("_of"), chunk_count(F.col("text_preview")).alias("_n"))), "_place")
        own = cut(rows.select(F.col("id").alias("extraction_id"), *shape[1:5], "created_at").join(of, "content_hash").select(*shape[:5], "created_at", "_place.*").where("_n > 0"))
        within = Window.partitionBy("_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
        placed = own.withColumns({"_part": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}).withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        placed = placed.join(before(sizes(own, F.col("_n"))), "_part").withColumn("_at", F.col("_before") + F.col("_at") + first + 1).drop("_part", "_m", "_n", "_before")
        by = ["_of", "content_hash"]
        texts = sifted(files.select(F.col("uri").alias("_of"), "content_hash", F.col("text_preview").alias("output")), own, by)
        # Files that repeat a uri and a content give one text.
        found = placed.join(texts, by).dropDuplicates([*by, "extraction_id"]).withColumn("mode", F.lit("metadata"))
        owns = chunked(found, "output").withColumn("id", F.col("_at") + F.col("chunk_idx"))
        return outputs.select("id", *shape[:-1], "chunk_idx", "chunk_text").unionByName(owns.select("id", *shape[:-1], "chunk_idx", "chunk_text"))

    def outputs(self, ids: DataFrame) -> DataFrame:
        """id and output of the stored extractions among ids (id): the tier of their own mode, whole."""
        base = self.manifest()
        known = self.read("extractions", buckets=self.touched("extractions", ids), of=base).join(ids.select("id").distinct(), "id", "left_semi")
        pieces = self.read("chunks", buckets=self.touched("chunks", known), of=base)
        wanted, by = known.select(F.col("id").alias("extraction_id"), "mode"), ["extraction_id", "mode"]
        pieces = sifted(pieces.select(*by, "chunk_idx", "chunk_text"), wanted, by)
        # All by the same two columns, so that texts move once.
        return wanted.join(reassembled(pieces.join(wanted, by), by), by, "left").select(F.col("extraction_id").alias("id"), F.coalesce("text", F.lit("")).alias("output"))

    def put_text_chunks(self, rows: DataFrame) -> int:
        """Chunks of whole texts that belong to no extraction, in place of earlier ones of the same content; rows: file_uri, content_hash, content, created_at."""
        base, chunks = self.manifest(), self.read("chunks")
        orphans = chunks.where(F.col("extraction_id").isNull() & (F.col("mode") == "metadata")).join(rows.select("content_hash").distinct(), "content_hash", "left_semi")
        around = self.touched("chunks", orphans.select("file_uri").unionByName(rows.select("file_uri")))
        first = chunks.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        now, _ = text_chunks(self.read("chunks", buckets=around, of=base), self.read("chunks_vec", of=base), rows, first)
        return self.commit(base, {"chunks_vec": self._without_vectors(base, orphans.select(F.col("id").alias("chunk_id"))), "chunks": self.staged("chunks", now, around)})

    def evict_extractions(self, ids: DataFrame) -> int:
        """Removes extractions (id) with their chunks and vectors; returns how many there were."""
        base = self.manifest()
        places = self.touched("extractions", ids)
        extractions = self.read("extractions", buckets=places, of=base)
        known = extractions.join(ids.select("id").distinct(), "id", "left_semi")
        n = known.count()
        if n:
            around = self.touched("chunks", known)
            chunks = self.read("chunks", buckets=around, of=base)
            gone = chunks.join(known.select(F.col("id").alias("extraction_id")), "extraction_id", "left_semi").select("id")
            staged = {"chunks_vec": self._without_vectors(base, gone.select(F.col("id").alias("chunk_id"))), "chunks": self.staged("chunks", chunks.join(gone, "id", "left_anti"), around)}
            self.commit(base, staged | {"extractions": self.staged("extractions", extractions.join(known.select("id"), "id", "left_anti"), places)})
        return n


def ranked(rows: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """Adds the number of each row in order within keys, from 1; a key's rows may lie in many ranges.

    Bounds of ranges are drawn from samples, so the rows are kept with the range they are in: both readings
    of them, for ranks and for the counts of ranges ahead, are of the same checkpoint.  Without keys a row's
    number in its range is the one that it has there once the range is sorted, and rows move once.
    """
    from pyspark.sql import Window

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not keys:
        sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
        placed = cut(sorted_).withColumns({"_part": F.shiftright("_m", 33), "_n": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1})
        sizes = placed.groupBy("_part").agg(F.max("_n").alias("_c"))  # a row for each range
        before = sizes.select(F.col("_part"), F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        return placed.join(F.broadcast(before), "_part").withColumn(column, F.col("_before") + F.col("_n")).select(*rows.columns, column)
    dealt = cut(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    within = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    # A row for each key and range.
    counts = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_c"))
    ahead = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return within.join(before, same).withColumn(column, F.col("_before") + F.col("_n")).select(*rows.columns, column)


def numbered(rows: DataFrame, order: list[str], base: int, column: str = "id") -> DataFrame:
    """Adds consecutive numbers from base + 1 in order."""
    return ranked(rows, [], order, column).withColumn(column, F.col(column) + base)


def upserted(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """stored with the rows of scanned (by uri) put in.

    Scan columns are overwritten; content columns stay as they were unless the scan brings one.  The ref
    of a file stays within a session and is replaced by that of another session.
    """
    old = stored.select(*(F.col(x).alias(f"_{x}") for x in stored.columns))
    both = old.join(scanned, F.col("_uri") == F.col("uri"), "full")
    is_new, known = F.col("uri").isNotNull(), F.col("_uri").isNotNull()
    out = []
    for name in stored.columns:
        if name not in scanned.columns:
            out.append(F.col(f"_{name}").alias(name))
        elif name in CONTENT_COLUMNS or name == "content_indexed_at":
            out.append(F.coalesce(F.col(f"_{name}"), F.col(name)).alias(name))
        elif name in ("session_id", "ref_id"):
            stays = known & (~is_new | F.col("session_id").isNull() | F.col("_session_id").eqNullSafe(F.col("session_id")) & F.col("_ref_id").isNotNull())
            out.append(F.when(stays, F.col(f"_{name}")).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.when(is_new, F.col(name)).otherwise(F.col(f"_{name}")).alias(name))
    return both.select(*out)


def by_uri(files: DataFrame, uri: str) -> DataFrame:
    return files.where(F.col("uri") == uri)


def by_ref(files: DataFrame, session: str, ref: str) -> DataFrame:
    return files.where((F.col("session_id") == session) & (F.col("ref_id") == ref))


def session_files(files: DataFrame, session: str) -> DataFrame:
    """A session's files in order of uri."""
    return files.where(F.col("session_id") == session).orderBy("uri")


def ensured(stored: DataFrame, scanned: DataFrame, uris: DataFrame) -> DataFrame:
    """stored with the scanned files of uris (uri) that are not stored yet; what the scan lacks is null, and other files stay out."""
    new = scanned.join(uris.select("uri").distinct(), "uri", "left_semi").join(stored.select("uri"), "uri", "left_anti").dropDuplicates(["uri"])
    return stored.unionByName(new.select(*(x for x in stored.columns if x in new.columns)), allowMissingColumns=True)


def text_chunks(chunks: DataFrame, vectors: DataFrame, rows: DataFrame, base: int | None = None) -> tuple[DataFrame, DataFrame]:
    """chunks and vectors with the texts of rows (file_uri, content_hash, content) as chunks of mode metadata that hang on no extraction.

    Earlier ones of the same content hash go, with their vectors.  base: the largest id so far, if chunks are not all.
    """
    orphan = F.col("extraction_id").isNull() & (F.col("mode") == "metadata")
    old = chunks.where(orphan).join(rows.select("content_hash").distinct(), "content_hash", "left_semi").select("id")
    kept = chunks.join(old, "id", "left_anti")
    base = chunks.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if base is None else base
    made = numbered(chunked(rows.dropDuplicates(["content_hash"]), "content").withColumns({"mode": F.lit("metadata"), "profile": F.lit(""), "model": F.lit("")}), ["file_uri", "content_hash", "chunk_idx"], base)
    made = made.select(*(F.col(f.name).cast(f.dataType) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in chunks.schema))
    return kept.select(*chunks.columns).unionByName(made), vectors.join(old.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")


def cascaded(files: DataFrame, extractions: DataFrame, chunks: DataFrame, vectors: DataFrame, uris: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without the files of uris (uri) and all that hangs on them."""
    by_uri = uris.select(F.col("uri").alias("file_uri")).distinct()
    gone = chunks.join(by_uri, "file_uri", "left_semi").select(F.col("id").alias("chunk_id"))
    return (
        files.join(uris, "uri", "left_anti"),
        extractions.join(by_uri, "file_uri", "left_anti"),
        chunks.join(by_uri, "file_uri", "left_anti"),
        vectors.join(gone, "chunk_id", "left_anti"),
    )


def replaced(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows in place of those of the same key; of rows that share one, any stays."""
    fresh = rows.dropDuplicates([key])
    return table.join(fresh.select(key), key, "left_anti").select(*table.columns).unionByName(fresh.select(*table.columns))


def latest_content(files: DataFrame, column: str = "text_preview") -> DataFrame:
    """content_hash and the text preview (or another column) of the file that was indexed last."""
    known = files.where(F.col("content_hash").isNotNull() & F.col("content_indexed_at").isNotNull())
    return known.groupBy("content_hash").agg(F.max_by(column, F.struct("content_indexed_at", "uri")).alias(column))


def upsert_vectors(chunks: DataFrame, vectors: DataFrame, embeddings: DataFrame) -> DataFrame:
    """vectors with those of embeddings (file_uri, ordinal, embedding) put to the chunks in order of mode and index."""
    from pyspark.sql import Window

    place = chunks.withColumn("ordinal", F.row_number().over(Window.partitionBy("file_uri").orderBy("mode", "chunk_idx")) - 1)
    made = place.join(embeddings, ["file_uri", "ordinal"]).select(F.col("id").alias("chunk_id"), "embedding")
    dims = made.unionByName(vectors).select(F.size("embedding").alias("d")).agg(F.min("d"), F.max("d")).first()
    if dims[0] != dims[1]:
        raise ValueError(f"vectors of {dims[0]} and {dims[1]} numbers")
    return replaced(vectors, made, "chunk_id")


def hash_of(kind: Column, content_hash: Column, phash: Column) -> Column:
    """Images are keyed by what they look like, all else by content."""
    return F.when((kind == "image") & phash.isNotNull(), F.concat(F.lit("phash:"), phash)).otherwise(content_hash)


def misses(wanted: DataFrame, extractions: DataFrame) -> DataFrame:
    """The requests (id) that no stored extraction answers."""
    return wanted.join(extractions.select("id"), "id", "left_anti")


def with_extraction_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", extraction_id(F.col("content_hash"), F.col("profile"), F.col("model"), F.col("mode"), F.col("detail") == 1, F.lit("")))


def pruned(files: DataFrame, on_disk: DataFrame, prefix: str | None = None) -> DataFrame:
    """files without those (below prefix) that are not on disk."""
    from .catalog import prune_candidates

    return files.join(prune_candidates(files, on_disk, prefix), "uri", "left_anti")
