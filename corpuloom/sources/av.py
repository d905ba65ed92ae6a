"""Metadata of video and audio files from their containers, in tasks, without a codec library."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import arrow_map

MP4, MATROSKA, AUDIO = (".mp4", ".m4v", ".mov", ".3gp", ".m4a"), (".mkv", ".webm"), (".wav", ".flac", ".mp3", ".aiff")
FIELDS = ("dimensions", "duration_s", "fps", "video_codec", "audio_codec", "has_audio")


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        size = end - at if size == 0 else size
        if size < head:
            return
        yield kind, at + head, min(end, at + size)
        at += size


def _inside(data: bytes, span: tuple[int, int], *path: bytes) -> tuple[int, int] | None:
    for name in path:
        span = next(((a, b) for kind, a, b in _boxes(data, *span) if kind == name), None)
        if span is None:
            return None
    return span


def mp4(data: bytes) -> dict:
    """Size, duration, frame rate and codecs of an MP4 or QuickTime file."""
    out: dict = {"has_audio": False}
    movie = _inside(data, (0, len(data)), b"moov")
    if not movie:
        return {}
    for kind, a, b in _boxes(data, *movie):
        if kind == b"mvhd":
            wide = data[a] == 1
            scale, length = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
            out["duration_s"] = length / scale if scale else None
        elif kind == b"trak":
            media = _inside(data, (a, b), b"mdia")
            handler, table = media and _inside(data, media, b"hdlr"), media and _inside(data, media, b"minf", b"stbl")
            described = table and _inside(data, table, b"stsd")
            if not handler or not described:
                continue
            what, codec = data[handler[0] + 8 : handler[0] + 12], data[described[0] + 12 : described[0] + 16].decode("latin-1").strip()
            if what == b"soun":
                out |= {"has_audio": True, "audio_codec": codec}
            elif what == b"vide":
                width, height = struct.unpack_from(">HH", data, described[0] + 8 + 32)
                out |= {"video_codec": codec, "dimensions": f"{width}x{height}"}
                times, clock = _inside(data, table, b"stts"), _inside(data, media, b"mdhd")
                if times and clock:
                    (n,) = struct.unpack_from(">I", data, times[0] + 4)
                    pairs = [struct.unpack_from(">II", data, times[0] + 8 + 8 * i) for i in range(n)]
                    wide = data[clock[0]] == 1
                    (scale,) = struct.unpack_from(">I", data, clock[0] + (20 if wide else 12))
                    frames, ticks = sum(c for c, _ in pairs), sum(c * d for c, d in pairs)
                    if ticks:
                        out["fps"] = round(frames * scale / ticks, 3)
    return out


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    first, n = data[at], 1
    while n <= 8 and not first & (0x80 >> (n - 1)):
        n += 1
    value = int.from_bytes(data[at : at + n], "big")
    return (value if keep else value & ((1 << (7 * n)) - 1)), at + n


# Element ids of the Matroska format.
_SEGMENT, _INFO, _SCALE, _DURATION, _TRACKS, _ENTRY, _TYPE, _CODEC, _VIDEO, _WIDTH, _HEIGHT, _PERIOD = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE, 0x83, 0x86, 0xE0, 0xB0, 0xBA, 0x23E383


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end - 1:
        ident, at = _vint(data, at, True)
        size, body = _vint(data, at, False)
        at = min(end, body + size)
        yield ident, body, at


def matroska(data: bytes) -> dict:
    """Size, duration, frame rate and codecs of a Matroska or WebM file."""
    out: dict = {"has_audio": False}
    segment = next(((a, b) for i, a, b in _elements(data, 0, len(data)) if i == _SEGMENT), None)
    if not segment:
        return {}
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    for ident, a, b in _elements(data, *segment):
        if ident == _INFO:
            found = {i: (x, y) for i, x, y in _elements(data, a, b)}
            scale = number(*found[_SCALE]) if _SCALE in found else 1_000_000
            if _DURATION in found:
                x, y = found[_DURATION]
                out["duration_s"] = struct.unpack(">f" if y - x == 4 else ">d", data[x:y])[0] * scale / 1e9
        elif ident == _TRACKS:
            for i, x, y in _elements(data, a, b):
                if i != _ENTRY:
                    continue
                track = {j: (p, q) for j, p, q in _elements(data, x, y)}
                kind, codec = number(*track[_TYPE]), data[slice(*track[_CODEC])].decode("latin-1").rstrip("\0") if _CODEC in track else None
                if kind == 2:
                    out |= {"has_audio": True, "audio_codec": codec}
                elif kind == 1:
                    out["video_codec"] = codec
                    if _VIDEO in track:
                        size = {j: number(p, q) for j, p, q in _elements(data, *track[_VIDEO]) if j in (_WIDTH, _HEIGHT)}
                        out["dimensions"] = f"{size.get(_WIDTH)}x{size.get(_HEIGHT)}"
                    if _PERIOD in track and number(*track[_PERIOD]):
                        out["fps"] = round(1e9 / number(*track[_PERIOD]), 3)
    return out


def audio(data: bytes) -> dict:
    """Codec and duration of WAV, FLAC, AIFF and constant-rate MP3 data."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        at, rate, size = 12, 0, 0
        while at + 8 <= len(data):
            kind, n = struct.unpack_from("<4sI", data, at)
            if kind == b"fmt ":
                (rate,) = struct.unpack_from("<I", data, at + 16)
            elif kind == b"data":
                size = n
            at += 8 + n + n % 2
        return {"audio_codec": "pcm", "has_audio": True, "duration_s": size / rate if rate else None}
    if data[:4] == b"fLaC":
        packed = int.from_bytes(data[18:26], "big")
        rate, samples = packed >> 44, packed & ((1 << 36) - 1)
        return {"audio_codec": "flac", "has_audio": True, "duration_s": samples / rate if rate else None}
    if data[:4] == b"FORM" and data[8:12] in (b"AIFF", b"AIFC"):
        return {"audio_codec": "pcm", "has_audio": True}
    start = 0
    if data[:3] == b"ID3":
        start = 10 + sum((x & 0x7F) << 7 * (3 - i) for i, x in enumerate(data[6:10]))
    if data[start : start + 1] == b"\xff" and len(data) > start + 4 and data[start + 1] & 0xE6 == 0xE2:
        rates = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0)  # kbit/s of MPEG-1 layer III
        kbits = rates[data[start + 2] >> 4]
        return {"audio_codec": "mp3", "has_audio": True, "duration_s": (len(data) - start) * 8 / (kbits * 1000) if kbits else None}
    return {}


def metadata(ext: str, data: bytes) -> dict:
    """What the container says; empty for other or broken files."""
    ext = ext.lower()
    try:
        return mp4(data) if ext in MP4 else matroska(data) if ext in MATROSKA else audio(data) if ext in AUDIO else {}
    except (struct.error, IndexError, KeyError, ValueError):
        return {}


def extract_media(files: DataFrame, data: str = "content") -> DataFrame:
    """path, content_hash and FIELDS of files (path, ext, bytes)."""
    kinds = {"dimensions": pa.string(), "duration_s": pa.float64(), "fps": pa.float64(), "video_codec": pa.string(), "audio_codec": pa.string(), "has_audio": pa.bool_()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [d or b"" for d in batch["data"].to_pylist()]
            got = [metadata(e or "", d) for e, d in zip(batch["ext"].to_pylist(), raw, strict=True)]
            columns = [pa.array([g.get(f) for g in got], kinds[f]) for f in FIELDS]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array([hashlib.sha256(d).hexdigest() for d in raw]), *columns], ["path", "content_hash", *FIELDS])

    shape = "path string, content_hash string, dimensions string, duration_s double, fps double, video_codec string, audio_codec string, has_audio boolean"
    return arrow_map(files.selectExpr("path", "ext", f"`{data}` AS data"), read, shape)
