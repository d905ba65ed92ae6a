"""URL rules by a sort-merge range join over reversed-host keys.

A rule (verdict, host, path) fits its host and all subdomains where the URL's
path starts with the rule's.  A key is the host's labels in reverse, a
separator, and the path, so that a rule is the interval of all keys that it
begins.  A URL has one key for each suffix of its host's labels.  Rules and
keys are dealt into the same key ranges (a rule to every range that its
interval meets, a key that fills several ranges to one of them) and sorted; one
sweep of a range keeps a stack of the rules that are open, and the top is the
longest of its host.  Of the finds for a URL's suffixes the longest rule wins.

Rules are rows like any other; only the range bounds, drawn from a bounded
sample of keys, are known to every task.

Defined results: a null URL or one without :// has empty host and path, and no
rule; rules with a null are ignored; of rules with the same host and path a
block stands above an allow; of rules of equal length the longer host wins;
repeated pages are judged alike.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, partitions, prepared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = "\x01"
LAST = "\U0010ffff"
#: Keys in the sample for each range.
SAMPLE = 64

_EVENT = "pid int, key string, at int, host string, path string, rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between :// and the first of / ? # in lower case (A-Z), and then up to ? or #."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    after = F.coalesce(after, F.lit(""))
    return F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def key_of(host: str, path: str) -> str:
    return ".".join(reversed(host.split("."))) + SEPARATOR + path


def _url_keys(host: str, path: str) -> list[str]:
    labels = host.split(".")
    return [".".join(reversed(labels[i:])) + SEPARATOR + path for i in range(len(labels))] if host else []


def _keys_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [k for host, path in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True) for k in _url_keys(host, path)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["pid", "key", "at", "host", "path", "rule", "verdict"])


def _dealt_urls(bounds: list[str]):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, path in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True):
                for key in _url_keys(host, path):
                    low, high = bisect_left(bounds, key), bisect_right(bounds, key)
                    pid = low if low == high else low + xxhash.xxh3_64_intdigest(host) % (high - low + 1)
                    rows.append((pid, key, 1, host, path, None, None))
            yield _packed(rows)

    return deal


def _dealt_rules(bounds: list[str]):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, path, verdict in zip(*(batch[x].to_pylist() for x in ("host", "path", "verdict")), strict=True):
                key = key_of(host, path)
                for pid in range(bisect_left(bounds, key), bisect_right(bounds, key + LAST) + 1):
                    rows.append((pid, key, 0, host, path, host + path, verdict))
            yield _packed(rows)

    return deal


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack, own = [], None
    for batch in batches:
        out = []
        for pid, key, at, host, path, rule, verdict in zip(*(batch[x].to_pylist() for x in ("pid", "key", "at", "host", "path", "rule", "verdict")), strict=True):
            if pid != own:
                stack, own = [], pid
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not at:
                stack.append((key, host, rule, verdict))
            elif stack:
                _, of, top, says = stack[-1]
                out.append((host, path, len(top), len(of), top, says))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "path", "length", "host_length", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, *, keys: list[str], default: str = "allow") -> DataFrame:
    """keys, host, path, rule (null if none) and verdict of each row of pages (url); rules: verdict, host, path.

    Of the four columns, one whose name is among keys gets an underscore.
    """
    spark = prepared(pages.sparkSession)
    n = partitions(spark)
    host, path = host_and_path(F.col("url"))
    named = pages.select(*(F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)), host.alias("_host"), path.alias("_path"))
    # What has no host has no rule, and would be one hot key.
    urls = cut(named.where("_host != ''").select(F.col("_host").alias("host"), F.col("_path").alias("path")).distinct())
    sample = urls.mapInArrow(_keys_only, "key string").orderBy(F.xxhash64("key"), "key").limit(SAMPLE * n)
    drawn = sorted(r["key"] for r in sample.collect())
    bounds = [drawn[len(drawn) * i // n] for i in range(1, n)] if drawn else []
    valid = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").dropna()
    events = urls.mapInArrow(_dealt_urls(bounds), _EVENT).unionByName(valid.mapInArrow(_dealt_rules(bounds), _EVENT))
    swept = events.repartitionById(len(bounds) + 1, F.col("pid")).sortWithinPartitions("pid", "key", "at", "verdict")
    found = swept.mapInArrow(_sweep, "host string, path string, length int, host_length int, rule string, verdict string")
    best = found.groupBy("host", "path").agg(F.max(F.struct("length", "host_length", "rule", "verdict")).alias("best"))
    judged = named.where("_host != ''").join(best, (F.col("_host") == F.col("host")) & (F.col("_path") == F.col("path")), "left").drop("host", "path")
    every = judged.unionByName(named.where("_host = ''"), allowMissingColumns=True)
    out = {"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(default))}
    return every.select(*(F.col(f"_c{i}").alias(k) for i, k in enumerate(keys)), *(x.alias(fresh(name, keys)) for name, x in out.items()))
