"""A registry of encoders: functions of a row's text or bytes that give message parts.

An encoder is called in tasks, one Arrow batch at a time, as encoder(uri, data,
options) and yields (message, part, type, text).  Text encoders are built in;
those that need a media library are registered by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import arrow_map

Encoder = Callable[[str, object, dict], Iterator[tuple[int, int, str, str]]]
_REGISTRY: dict[str, Encoder] = {}
SCHEMA = "uri string, message int, part int, type string, text string"


def register(kind: str, name: str) -> Callable[[Encoder], Encoder]:
    def add(encoder: Encoder) -> Encoder:
        _REGISTRY[f"{kind}/{name}"] = encoder
        return encoder

    return add


def names(kind: str | None = None) -> list[str]:
    return sorted(x for x in _REGISTRY if kind is None or x.startswith(f"{kind}/"))


@register("document", "page-text")
def page_text(uri: str, data: object, options: dict) -> Iterator[tuple[int, int, str, str]]:
    """Pages split at form feeds, marked and batched."""
    pages, size = str(data or "").split("\f"), int(options.get("pages_per_message", 4))
    for first in range(0, len(pages), size):
        body = "\n\n".join(f"--- Page {i + 1} ---\n{pages[i]}" for i in range(first, min(first + size, len(pages))))
        yield first // size, 0, "text", body


@register("text", "plain")
def plain(uri: str, data: object, options: dict) -> Iterator[tuple[int, int, str, str]]:
    yield 0, 0, "text", str(data or "")


@register("audio", "transcript-lines")
def transcript_lines(uri: str, data: object, options: dict) -> Iterator[tuple[int, int, str, str]]:
    """Lines [12.0s - 15.5s] text of (start, end, text) segments recorded at a speed."""
    speed = float(options.get("speed", 1.0))
    for i, (start, end, text) in enumerate(data or []):
        yield 0, i, "text", f"[{start * speed:.1f}s - {end * speed:.1f}s] {text}"


Transform = Callable[[list[dict], dict], list[dict]]


def encoded(files: DataFrame, encoder: str, options: dict | None = None, *, uri: str = "path", data: str = "text", transform: Transform | None = None) -> DataFrame:
    """uri, message, part, type and text of all parts of each file.

    transform, a function (never source text), takes all parts of a file as (message, part, type, text) and a context
    (uri and the options) and gives the parts to keep; those without message or part come in order in message 0.
    """
    run, options = _REGISTRY[encoder], options or {}

    def parts(u: str, x: object) -> Iterator[tuple[int, int, str, str]]:
        if transform is None:
            yield from run(u, x, options)
            return
        made = [dict(zip(("message", "part", "type", "text"), p, strict=True)) for p in run(u, x, options)]
        for i, p in enumerate(transform(made, {"uri": u, **options})):
            yield p.get("message", 0), p.get("part", i), p.get("type", "text"), p["text"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(u, *part) for u, x in zip(batch["uri"].to_pylist(), batch["data"].to_pylist(), strict=True) for part in parts(u, x)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["uri", "message", "part", "type", "text"])

    slim = files.selectExpr(f"`{uri}` AS uri", f"`{data}` AS data")
    return arrow_map(slim, encode, SCHEMA)
