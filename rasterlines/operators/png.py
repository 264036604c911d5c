"""PNG in and out, for rasters of 8-bit grey, grey with alpha, RGB and RGBA."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..functions.admission import PNG_SIGNATURE

# Channels of the colour types that are admitted.
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


class ImageError(ValueError):
    """The image is not one that can be read."""


def _chunks(content: bytes):
    at = len(PNG_SIGNATURE)
    while at < len(content):
        if at + 12 > len(content):
            raise ImageError("truncated chunk")
        (size,) = struct.unpack_from(">I", content, at)
        kind, body = content[at + 4 : at + 8], content[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(content):
            raise ImageError("truncated chunk")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", content, at + 8 + size)[0]:
            raise ImageError("checksum")
        yield kind, body
        at += 12 + size


def decode(content: bytes, max_bytes: int) -> np.ndarray:
    """height x width x 3 bytes; transparency is laid on white.  Animated and 16-bit images are errors."""
    if content[:8] != PNG_SIGNATURE:
        raise ImageError("signature")
    header, data, ended = None, [], False
    for kind, body in _chunks(content):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"acTL":
            raise ImageError("animated")
        elif kind == b"IEND":
            ended = True
    if header is None or not ended:
        raise ImageError("incomplete")
    width, height, depth, colour, compression, method, interlace = header
    if depth != 8 or colour not in _CHANNELS or compression or method or interlace or not width or not height or width * height * 3 > max_bytes:
        raise ImageError("unsupported")
    n = _CHANNELS[colour]
    try:
        raw = zlib.decompressobj().decompress(b"".join(data), height * (width * n + 1))
    except zlib.error as e:
        raise ImageError("data") from e
    if len(raw) != height * (width * n + 1):
        raise ImageError("length")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * n + 1)
    pixels = _unfilter(lines[:, 0], lines[:, 1:].reshape(height, width, n))
    if n in (2, 4):
        alpha = pixels[..., -1:].astype(np.int32)
        pixels = ((pixels[..., :-1].astype(np.int32) * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)
    return np.repeat(pixels, 3, 2) if pixels.shape[2] == 1 else pixels


def _unfilter(filters: np.ndarray, lines: np.ndarray) -> np.ndarray:
    out = np.zeros_like(lines)
    above = np.zeros_like(lines[0])
    for y, kind in enumerate(filters.tolist()):
        line = lines[y]
        if kind == 0:
            done = line.copy()
        elif kind == 1:
            done = np.cumsum(line, 0, dtype=np.uint8)
        elif kind == 2:
            done = line + above
        elif kind in (3, 4):
            done = np.zeros_like(line)
            left = upper_left = np.zeros(line.shape[1], np.int32)
            for x in range(len(line)):
                up = above[x].astype(np.int32)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    base = left + up - upper_left
                    a, b, c = abs(base - left), abs(base - up), abs(base - upper_left)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, upper_left))
                done[x] = (line[x] + guess) & 255
                left, upper_left = done[x].astype(np.int32), up
        else:
            raise ImageError("filter")
        out[y] = above = done
    return out


def encode(pixels: np.ndarray) -> bytes:
    """A PNG of height x width x 3 bytes, unfiltered."""
    height, width, _ = pixels.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, -1)], 1)
    return PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")
