"""Files as a stream of scans: what is new, stale and gone, kept per uri; and sessions of events.

Each scan row (uri, modified, size, seen_at) is held against what the state store knows of
its uri: nothing (new), another time or size (stale) or the same (nothing is said).  A uri
that no scan has shown for ``after`` of event time is gone: every sighting moves its timer,
which fires when the watermark has passed it.  The state is a row a uri, kept by RocksDB on
disk and checkpointed, so it may outgrow memory; uris are spread by their hash.

The files of a store can be given as the first state, so that a stream says of them what
catalog.stale() and catalog.prune_candidates() say of tables.

Defined results: null uris, and rows without seen_at, say nothing; of sightings of one uri in a batch, the
latest counts (by seen_at, modified, size); sightings older than what is known change
nothing but are not stale; a uri that was gone and is seen again is new.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import workers_find_us

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEEN = "uri string, modified bigint, size bigint, seen_at timestamp"
CHANGES = "uri string, change string, modified bigint, size bigint, at timestamp"


class Watch(StatefulProcessor):
    """One uri's last sighting and the timer after which it is gone."""

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "modified bigint, size bigint, at_ms bigint")

    def _seen(self, modified: int, size: int, at_ms: int) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.last.update((modified, size, at_ms))
        self.handle.registerTimer(at_ms + self.after_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = max(rows, key=lambda r: (r["at_ms"], r["modified"] is not None, r["modified"] or 0, r["size"] is not None, r["size"] or 0))
        now = best["modified"], best["size"]
        known = self.last.get() if self.last.exists() else None
        if known is not None and known[2] > best["at_ms"]:
            return
        self._seen(*now, best["at_ms"])
        change = "new" if known is None else "stale" if (known[0], known[1]) != now else None
        if change:
            yield Row(uri=key[0], change=change, modified=now[0], size=now[1], at=best["seen_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        import datetime

        modified, size, at_ms = self.last.get()
        self.last.clear()
        yield Row(uri=key[0], change="gone", modified=modified, size=size, at=datetime.datetime.fromtimestamp((at_ms + self.after_ms) / 1000, datetime.timezone.utc))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._seen(initialState["modified"], initialState["size"], initialState["at_ms"])

    def close(self) -> None:
        pass


def watched(scans: DataFrame, *, after: str = "1 hour", late: str = "10 minutes", stored: DataFrame | None = None) -> DataFrame:
    """uri, change (new, stale or gone), modified, size and at of a stream of sightings (uri, modified, size, seen_at).

    after: how long a uri may go unseen; late: how far sightings may be out of order.  stored: (uri, modified,
    size, seen_at) known from the start.  The session's state store must be RocksDB: see with_state().
    """
    spark = workers_find_us(scans.sparkSession)
    after_ms = spark.sql(f"SELECT CAST(unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {after}) AS BIGINT)").first()[0]
    slim = lambda df: df.where("uri IS NOT NULL AND seen_at IS NOT NULL").select("uri", F.col("modified").cast("bigint").alias("modified"), F.col("size").cast("bigint").alias("size"), F.col("seen_at").cast("timestamp").alias("seen_at")).withColumn("at_ms", F.unix_millis("seen_at"))
    keyed = slim(scans).withWatermark("seen_at", late).groupBy("uri")
    first = None if stored is None else slim(stored).groupBy("uri").agg(F.max_by(F.struct("modified", "size", "at_ms"), F.struct("at_ms", "modified", "size")).alias("s")).select("uri", "s.modified", "s.size", "s.at_ms").groupBy("uri")
    return keyed.transformWithState(Watch(after_ms), CHANGES, "append", "eventTime", first)


def with_state(spark: SparkSession) -> SparkSession:
    """Keeps streaming state in RocksDB, as watched() needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """keys, session_start, session_end (the last event and the gap), n and total of runs of events no further apart than gap; for a table or a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    grouped = timed.groupBy(*keys, F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(*keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n", "total")
