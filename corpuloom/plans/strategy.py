"""Which encoder suits a file, what it costs, and how pipelines are put together."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MB = 1024 * 1024
# What scanning programs call themselves.
SCANNERS = ("scansnap", "twain", "hp", "adobescan", "exactscan", "scanner", "camscanner", "scanbot", "readiris", "epson scan")


def auto_strategy(kind: Column, ext: Column, size: Column, *, duration: Column, has_audio: Column, width: Column, height: Column, pages: Column, creator: Column, producer: Column) -> Column:
    """The encoder for a media file as one expression over its metadata; null for other kinds."""
    ext = F.lower(ext)
    seconds = F.coalesce(duration, F.lit(0.0))
    video = F.when((seconds <= 600) & (size <= 25 * MB), "mosaic").when((seconds <= 2100) & (size <= 100 * MB), "keyframes").otherwise("summary")
    video = F.concat(video, F.when(F.coalesce(has_audio, F.lit(False)), "-w-transcript").otherwise(""))
    audio = F.when((seconds <= 300) & (size <= 10 * MB), "transcribe").otherwise("native")
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    long_, short = F.greatest(w, h), F.least(w, h)
    tiled = (short > 0) & (long_ > 3 * short) | (w > 3840) | (h > 2160) | (size > 10 * MB) | ext.isin(".heic", ".heif") | ext.isin(".png", ".tiff", ".tif", ".bmp") & ((w > 1920) | (h > 1080))
    n = F.coalesce(pages, F.lit(0))
    heavy = F.when(n > 0, size > n * (500 * 1024)).otherwise(size > 5 * MB)
    made_by = F.lower(F.concat_ws(" ", F.coalesce(creator, F.lit("")), F.coalesce(producer, F.lit(""))))
    scanned = F.lit(False)
    for token in SCANNERS:
        scanned = scanned | F.contains(made_by, F.lit(token))
    document = F.when((ext != ".pdf") | (n > 100) | ~heavy, "page-text").when(scanned, "rasterize").otherwise("rasterize-text")
    return F.when(kind == "video", video).when(kind == "audio", audio).when(kind == "image", F.when(tiled, "tile").otherwise("resize")).when(kind == "document", document)


# ---------------------------------------------------------------- cost

FRAME_BASE, FRAME_TILE, TILE = 85, 170, 512
AUDIO_PER_SECOND, PER_CHARACTER = 25, 0.75


def frame_tokens(width: Column, height: Column) -> Column:
    """A base and so much for each 512-pixel tile, at least one tile."""
    return (F.lit(FRAME_BASE) + F.greatest(F.lit(1), F.ceil(width / TILE)) * F.greatest(F.lit(1), F.ceil(height / TILE)) * FRAME_TILE).cast("bigint")


def media_cost_tokens(media: Column, seconds: Column, keyframes_per_s: Column, width: Column, height: Column, characters: Column) -> Column:
    """Tokens of video by key frames, audio by seconds, documents by characters."""
    video = F.floor(seconds * keyframes_per_s) * frame_tokens(width, height)
    return F.when(media == "video", video).when(media == "audio", F.floor(seconds * AUDIO_PER_SECOND)).otherwise(F.floor(characters * PER_CHARACTER)).cast("bigint")


def priced(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """Every row with every provider's cost; prices (provider, per_mtok) is a stated short list."""
    return tokens.crossJoin(F.broadcast(prices)).withColumn("cost", F.round(F.col("tokens") * F.col("per_mtok") / 1e6, 6))


# ---------------------------------------------------------------- pipelines


def deep_merged(base: dict, over: dict) -> dict:
    """base with over put in, dictionary by dictionary; over wins."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def coerced(value: str, kind: type) -> object:
    """A text option as int, float, bool or JSON."""
    if kind is bool:
        return value.strip().lower() in ("1", "true", "yes", "on")
    if kind in (dict, list):
        return json.loads(value)
    return kind(value)


def rendered_prompt(template: str, values: dict) -> str:
    """{name} replaced by its value, or by nothing."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values.get(m[1], "")), template)


def rendered_prompts(template: str, columns: dict[str, Column]) -> Column:
    """As rendered_prompt(), a row at a time."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(columns.get(p, F.lit("")).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


#: Encoders whose output is the answer: no model is asked after them.
FINAL_ENCODERS = frozenset({"transcribe", "page-text", "transcript", "captions"})


def resolved_pipeline(kind: str, *, built_in: dict, custom: dict | None = None, encoder: str | None = None, overrides: dict | None = None) -> dict:
    """A custom pipeline for the kind, else an encoder on the base, else the built-in; then overrides.

    An encoder whose output is final drops the generate step, whatever else says otherwise.
    """
    spec = (custom or {}).get(kind) or built_in[kind]
    spec = deep_merged(spec, overrides or {})
    if encoder:
        spec = deep_merged(spec, {"encode": {"strategy": encoder}})
    if spec.get("encode", {}).get("strategy") in FINAL_ENCODERS:
        spec = {k: v for k, v in spec.items() if k != "generate"}
    return spec


def passes_through(kind: Column, ext: Column, mode: Column) -> Column:
    """Texts always; documents other than PDF unless an office file is read accurately."""
    office = F.lower(ext).isin(".docx", ".odt", ".pptx", ".odp", ".xlsx", ".ods")
    return (kind == "text") | (kind == "document") & (F.lower(ext) != ".pdf") & ~(office & (mode == "accurate"))
