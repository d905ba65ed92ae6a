"""Content columns by kind: text natively, images in tasks."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import content_hash
from ..functions.media import perceptual_hash
from ..functions.text import clock, human_size, line_count, preview, word_count
from ..session import arrow_map
from .av import extract_media
from .files import image_size, language_of
from .pixels import grey


def extract_text(files: DataFrame) -> DataFrame:
    """path and the content columns of text-like files: hash, preview, lines, words, language."""
    text = F.col("text")
    return files.select("path", content_hash(text).alias("content_hash"), preview(text).alias("text_preview"), line_count(text).alias("line_count"), word_count(text).alias("word_count"), language_of(F.col("ext")).alias("language"))


MAGIC = ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"BM", "image/bmp"), (b"%PDF-", "application/pdf"), (b"PK\x03\x04", "application/zip"))


def magic_mime(data: bytes) -> str | None:
    """By the first bytes."""
    return next((mime for head, mime in MAGIC if data.startswith(head)), None)


# Tags of the Exif standard.
_MAKE, _MODEL, _ORIENTATION, _TIME, _EXIF, _GPS, _ORIGINAL = 0x010F, 0x0110, 0x0112, 0x0132, 0x8769, 0x8825, 0x9003
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _tags(tiff: bytes, at: int, end: str) -> dict[int, object]:
    out = {}
    (n,) = struct.unpack_from(f"{end}H", tiff, at)
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{end}HHI", tiff, at + 2 + 12 * i)
        size = _SIZES.get(kind, 1) * count
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(f"{end}I", tiff, at + 10 + 12 * i)[0]
        raw = tiff[where : where + size]
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("ascii", "replace").strip()
        elif kind in (3, 4):
            out[tag] = struct.unpack(f"{end}{count}{'H' if kind == 3 else 'I'}", raw)[0]
        elif kind == 5:
            parts = struct.unpack(f"{end}{2 * count}I", raw)
            out[tag] = [a / b if b else 0.0 for a, b in zip(parts[::2], parts[1::2], strict=True)]
    return out


def exif(data: bytes) -> dict[str, str]:
    """camera, date, gps and orientation of a JPEG's Exif block, as far as there."""
    at = data.find(b"Exif\0\0", 0, 1 << 16)
    if data[:2] != b"\xff\xd8" or at < 0:
        return {}
    try:
        tiff = data[at + 6 :]
        end = "<" if tiff[:2] == b"II" else ">"
        top = _tags(tiff, struct.unpack_from(f"{end}I", tiff, 4)[0], end)
        more = _tags(tiff, top[_EXIF], end) if _EXIF in top else {}
        out = {"camera": " ".join(str(top[t]) for t in (_MAKE, _MODEL) if t in top), "date": str(more.get(_ORIGINAL) or top.get(_TIME) or ""), "orientation": str(top.get(_ORIENTATION, ""))}
        place = _tags(tiff, top[_GPS], end) if _GPS in top else {}
        if 2 in place and 4 in place:
            signs = [-1 if place.get(t) in ("S", "W") else 1 for t in (1, 3)]
            degrees = [s * (d[0] + d[1] / 60 + d[2] / 3600) for s, d in zip(signs, (place[2], place[4]), strict=True)]
            out["gps"] = f"{degrees[0]:.6f},{degrees[1]:.6f}"
        return {k: v for k, v in out.items() if v}
    except (struct.error, IndexError, KeyError):
        return {}


def extract_images(files: DataFrame, data: str = "content", decode: Callable[[bytes], np.ndarray | None] = grey) -> DataFrame:
    """path, content_hash, dimensions, magic_mime, phash and exif_* of image bytes; what cannot be read is null.

    decode gives an image's grey pixels or None; the built-in one reads PNG and BMP without a media library.
    """
    names = ["content_hash", "dimensions", "magic_mime", "phash", "exif_camera", "exif_date", "exif_gps", "exif_orientation"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch["data"].to_pylist():
                raw = raw or b""
                size, tags, pixels = image_size(raw), exif(raw), decode(raw)
                rows.append((hashlib.sha256(raw).hexdigest(), f"{size[0]}x{size[1]}" if size else None, magic_mime(raw), perceptual_hash(pixels) if pixels is not None else None, *(tags.get(k) for k in ("camera", "date", "gps", "orientation"))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch["path"], *(pa.array(c, pa.string()) for c in columns)], ["path", *names])

    return arrow_map(files.selectExpr("path", f"`{data}` AS data"), read, f"path string, {', '.join(f'{n} string' for n in names)}")


def extract_hash(files: DataFrame, data: str = "content") -> DataFrame:
    """path and content_hash of bytes: all that is taken from documents, data and other files."""
    return files.select("path", F.sha2(F.coalesce(F.col(data), F.lit(b"")), 256).alias("content_hash"))


def extract_utf8(files: DataFrame, data: str = "content") -> DataFrame:
    """extract_text of bytes that are UTF-8; of others all but path and language is null."""
    return extract_text(files.withColumn("text", F.try_validate_utf8(F.col(data).cast("string"))))


#: What reads files (path, ext, kind, content) of a kind; the other kinds are only hashed.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"image": extract_images, "video": extract_media, "audio": extract_media, "code": extract_utf8, "text": extract_utf8, "config": extract_utf8}


def extract(files: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """path and the content columns of all files by the extractor of their kind; what a kind does not have is null.

    Files whose kind is null are hashed too.  extractors replace or add to EXTRACTORS; kinds of the same extractor share a
    pass over the files, and kind is filtered in the scan.
    """
    chosen, kinds_of = EXTRACTORS | (extractors or {}), {}
    for kind, run in chosen.items():
        kinds_of.setdefault(run, []).append(kind)
    rest = extract_hash(files.where(F.col("kind").isNull() | ~F.col("kind").isin(*chosen)))
    parts = [run(files.where(F.col("kind").isin(*kinds))) for run, kinds in kinds_of.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, rest])


def labelled(kind: Column) -> Column:
    """Metadata as Label: value lines by kind; lines without a value are left out.

    Reads dimensions, magic_mime, size, content_hash, phash, exif_*, duration_s, fps, video_codec, audio_codec, has_audio.
    """

    def line(label: str, value: Column | str, width: int = 12) -> Column:
        return F.concat(F.lit(f"{label}:".ljust(width)), (F.col(value) if isinstance(value, str) else value).cast("string"))

    size = human_size(F.col("size"))
    length = F.concat(clock(F.col("duration_s")), F.lit(" ("), F.format_string("%.2f", "duration_s"), F.lit("s)"))
    length = F.when(F.col("duration_s").isNotNull(), length)
    sound = F.coalesce(F.col("audio_codec"), F.when(~F.col("has_audio"), "none"))
    image = (line("Dimensions", "dimensions"), line("MIME", "magic_mime"), line("Size", size), line("Hash", "content_hash"), line("pHash", "phash"), line("Camera", "exif_camera"), line("Date", "exif_date"), line("GPS", "exif_gps"), line("Orientation", "exif_orientation", 13))
    video = (line("Resolution", "dimensions"), line("Duration", length), line("Size", size), line("FPS", "fps"), line("Video", "video_codec"), line("Audio", sound), line("Hash", "content_hash"))
    audio = (line("Duration", length, 10), line("Size", size, 10), line("Codec", "audio_codec", 10), line("Hash", "content_hash", 10))
    return F.when(kind == "image", F.concat_ws("\n", *image)).when(kind == "video", F.concat_ws("\n", *video)).when(kind == "audio", F.concat_ws("\n", *audio))
