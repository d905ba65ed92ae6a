"""Grey pixels of PNG and BMP images, from their bytes alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Images beyond this many pixels are not decoded.
MOST_PIXELS = 1 << 26

# Samples a pixel by PNG colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_RGB = np.array([0.299, 0.587, 0.114])


def grey(data: bytes) -> np.ndarray | None:
    """Rows of grey values (0 to 255), or None for other formats, interlaced images and broken bytes."""
    try:
        if data.startswith(b"\x89PNG\r\n\x1a\n"):
            return _png(data)
        return _bmp(data) if data.startswith(b"BM") else None
    except (struct.error, zlib.error, ValueError, IndexError):
        return None


def _png(data: bytes) -> np.ndarray | None:
    width, height, depth, colour, _, _, interlaced = struct.unpack_from(">IIBBBBB", data, 16)
    if interlaced or depth not in (8, 16) or colour not in _SAMPLES or not 0 < width * height <= MOST_PIXELS:
        return None
    packed, palette, at = [], None, 8
    while at + 8 <= len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8, size, at + 8).reshape(-1, 3)
        at += 12 + size
    n = _SAMPLES[colour] * depth // 8
    stride = width * n
    # One byte more than the image needs would be enough to tell a bomb.
    raw = zlib.decompressobj().decompress(b"".join(packed), height * (stride + 1))
    lines = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = _unfiltered(lines, n)
    samples = out.reshape(height, width, n)[:, :, :: depth // 8]
    if colour == 3:
        return None if palette is None else palette[samples[:, :, 0]] @ _RGB
    return samples[:, :, :3] @ _RGB if colour in (2, 6) else samples[:, :, 0].astype(np.float64)


def _unfiltered(lines: np.ndarray, n: int) -> np.ndarray:
    """The bytes of each line, whose first byte names the filter that the PNG standard undoes on it."""
    height, stride = lines.shape[0], lines.shape[1] - 1
    out = np.zeros((height + 1, stride), np.uint8)
    for y in range(height):
        kind, line, above = lines[y, 0], lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif kind == 2:
            out[y + 1] = line + above
        elif kind in (3, 4):
            out[y + 1] = _predicted(line.tolist(), above.tolist(), n, average=kind == 3)
        else:
            raise ValueError("unknown filter")
    return out[1:]


def _predicted(line: list[int], above: list[int], n: int, average: bool) -> list[int]:
    """A line whose bytes are told apart from a mean or from the nearest of left, above and corner (Paeth)."""
    out = [0] * len(line)
    for i, x in enumerate(line):
        left, up, corner = (out[i - n], above[i], above[i - n]) if i >= n else (0, above[i], 0)
        if average:
            guess = (left + up) >> 1
        else:
            base = left + up - corner
            guess = min((left, up, corner), key=lambda v: abs(base - v))
        out[i] = (x + guess) & 255
    return out


def _bmp(data: bytes) -> np.ndarray | None:
    (start,) = struct.unpack_from("<I", data, 10)
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if bits not in (24, 32) or packed or not 0 < width * abs(height) <= MOST_PIXELS:
        return None
    stride = (width * bits // 8 + 3) // 4 * 4
    lines = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    blue_first = lines[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, :3]
    rows = blue_first @ _RGB[::-1]
    return rows[::-1] if height > 0 else rows
