"""Deterministic ids and keys."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import REF_PREFIXES

REF = re.compile(r"^(?P<prefix>[a-z]{2,5})_(?P<suffix>[0-9a-f]{6})$")
GLOBAL_REF = r"^([A-Za-z0-9_\-]+)/([a-z]{2,5}_[0-9a-f]{6})$"


def content_hash(text: Column) -> Column:
    """SHA-256 in hex; Spark has no xxh3 of its own."""
    return F.sha2(text, 256)


def partial_hash(text: Column, edge: int = 65536) -> Column:
    """A fingerprint: of all bytes up to two edges, else of both edges and the size."""
    data = text.cast("binary")
    size = F.octet_length(text)
    ends = F.concat(F.substring(data, 1, edge), F.substring(data, -edge, edge), size.cast("string").cast("binary"))
    return F.sha2(F.when(size <= 2 * edge, data).otherwise(ends), 256)


def extraction_id(hash_: Column, profile: Column, model: Column, mode: Column, detail: Column, extra: Column) -> Column:
    """24 hex digits of the parameters an extraction depends on."""
    flag = F.when(detail, "True").otherwise("False")
    return F.left(F.sha2(F.concat_ws(":", hash_, profile, model, F.coalesce(mode, F.lit("")), flag, extra), 256), F.lit(24))


def cache_key(fingerprint: Column, *arguments: Column) -> Column:
    return F.sha1(F.concat_ws("\x1f", fingerprint, *arguments))


def override_string(overrides: dict) -> str:
    """The same text for the same overrides in any order."""
    return "|".join(f"{k}={json.dumps(overrides[k], sort_keys=True, separators=(',', ':'))}" for k in sorted(overrides))


def ref_id(kind: Column, session: Column, key: Column, attempt: int = 0) -> Column:
    """prefix_6hex, the same for the same session and key; attempt re-hashes after a collision."""
    prefix = F.coalesce(F.create_map(*(F.lit(x) for pair in REF_PREFIXES.items() for x in pair))[kind], F.lit("obj"))
    return F.concat(prefix, F.lit("_"), F.left(F.sha2(F.concat_ws("\x1f", session, key, F.lit(str(attempt))), 256), F.lit(6)))


def is_ref(text: Column) -> Column:
    return text.rlike(r"^[a-z]{2,5}_[0-9a-f]{6}$")


def ref_session(text: Column) -> Column:
    """The session of session/ref; null if it is none."""
    found = F.regexp_extract(text, GLOBAL_REF, 1)
    return F.when(found != "", found)


def ref_local(text: Column) -> Column:
    found = F.regexp_extract(text, GLOBAL_REF, 2)
    return F.when(found != "", found)
