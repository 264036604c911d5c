"""Pixel arithmetic of the two preprocessors and of region crops."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.raster import DETECTOR_LONG_SIDE, DETECTOR_MEAN, DETECTOR_STD, STRIDE

_F = np.float32


def taps(source: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left and right source index and 11-bit weights of each target position."""
    position = (np.arange(target) + 0.5) * (source / target) - 0.5
    low = np.floor(position).astype(np.int64)
    fraction = (position - low).astype(_F)
    before, after = (position < 0) | (source == 1), low >= source - 1
    left = np.where(before, 0, np.where(after, source - 1, low))
    w0 = np.where(before | after, 2048, np.rint((_F(1) - fraction) * _F(2048)).astype(np.int64))
    w1 = np.where(before | after, 0, np.rint(fraction * _F(2048)).astype(np.int64))
    return left, np.minimum(left + 1, source - 1), w0, w1


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear in fixed point, one rounding at the end; the same size is returned as it is."""
    if pixels.shape[:2] == (height, width):
        return pixels
    x0, x1, a0, a1 = taps(pixels.shape[1], width)
    y0, y1, b0, b1 = taps(pixels.shape[0], height)
    wide = pixels.astype(np.int64)
    rows = wide[:, x0] * a0[:, None] + wide[:, x1] * a1[:, None]
    return ((rows[y0] * b0[:, None, None] + rows[y1] * b1[:, None, None] + (1 << 21)) >> 22).astype(np.uint8)


def detector_size(width: int, height: int) -> tuple[int, int, int, int]:
    """(padded width, padded height, tensor width, tensor height)."""
    if width + height < 64:
        width, height = max(width, 32), max(height, 32)
    longest = max(width, height)

    def side(v: int) -> int:
        v = v * DETECTOR_LONG_SIDE // longest if longest > DETECTOR_LONG_SIDE else v
        return max(STRIDE, STRIDE * int(np.rint(v / STRIDE)))

    return width, height, side(width), side(height)


def detector_tensor(pixels: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(1 x 3 x H x W in BGR order, scale_x, scale_y); small images are padded with black."""
    height, width = pixels.shape[:2]
    pw, ph, tw, th = detector_size(width, height)
    padded = np.zeros((ph, pw, 3), np.uint8)
    padded[:height, :width] = pixels
    values = resize(padded, tw, th)[..., ::-1].astype(_F) / _F(255)
    values = (values - np.array(DETECTOR_MEAN, _F)) / np.array(DETECTOR_STD, _F)
    return values.transpose(2, 0, 1)[None], float(_F(tw) / _F(pw)), float(_F(th) / _F(ph))


def recogniser_batch(crops: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """(N x 3 x 48 x W, which crop each row is): by aspect, then number; right of a crop there are zeros."""
    order = sorted(range(len(crops)), key=lambda k: (crops[k].shape[1] / crops[k].shape[0], k))
    widths = [min(3200, max(1, -(-crop.shape[1] * 48 // crop.shape[0]))) for crop in crops]
    out = np.zeros((len(crops), 3, 48, min(3200, max(320, *widths))), _F)
    for row, k in enumerate(order):
        values = resize(crops[k], widths[k], 48)[..., ::-1].astype(_F) / _F(127.5) - _F(1)
        out[row, :, :, : widths[k]] = values.transpose(2, 0, 1)
    return out, order


@lru_cache(maxsize=1)
def cubic_tables() -> np.ndarray:
    """32 x 32 phases (y, x) of 4 x 4 weights in 15 bits, each summing to 2**15."""
    t = (np.arange(32) / 32).astype(_F)
    a = _F(-0.75)
    near, one = t + _F(1), _F(1) - t
    c0 = ((a * near - _F(5) * a) * near + _F(8) * a) * near - _F(4) * a
    c1 = ((a + _F(2)) * t - (a + _F(3))) * t * t + _F(1)
    c2 = ((a + _F(2)) * one - (a + _F(3))) * one * one + _F(1)
    c = np.stack([c0, c1, c2, _F(1) - c0 - c1 - c2], 1)
    table = np.rint(c[:, None, :, None] * c[None, :, None, :] * _F(32768)).astype(np.int64)
    short = 32768 - table.sum((2, 3))
    centre = [(1, 1), (1, 2), (2, 1), (2, 2)]
    for y, x in zip(*np.nonzero(short), strict=True):
        values = [table[y, x, j, i] for j, i in centre]
        # What is missing goes to the largest (the last of equals), what is too much to the smallest (the first).
        k = 3 - int(np.argmax(values[::-1])) if short[y, x] > 0 else int(np.argmin(values))
        table[y, x][centre[k]] += short[y, x]
    return table


def _quad_map(quad: np.ndarray, width: int, height: int) -> np.ndarray:
    """The projective map from the unit square's corners to the quad's, on x / width and y / height."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = quad
    dx1, dy1, dx2, dy2, sx, sy = x1 - x2, y1 - y2, x3 - x2, y3 - y2, x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    d = dx1 * dy2 - dx2 * dy1
    if d == 0:
        raise ValueError("degenerate quad")
    g, h = (sx * dy2 - dx2 * sy) / d, (dx1 * sy - sx * dy1) / d
    return np.array([[x1 - x0 + g * x1, x3 - x0 + h * x3, x0], [y1 - y0 + g * y1, y3 - y0 + h * y3, y0], [g, h, 1.0]]) @ np.diag([1 / width, 1 / height, 1.0])


def crop(pixels: np.ndarray, quad: list[tuple[float, float]]) -> np.ndarray:
    """The quad (clockwise from top left) straightened by cubic sampling with repeated borders; tall crops are turned left."""
    q = np.array(quad, float)
    length = lambda a, b: float(np.hypot(*(q[a] - q[b])))
    width, height = int(max(length(0, 1), length(3, 2))), int(max(length(0, 3), length(1, 2)))
    if width < 1 or height < 1:
        raise ValueError("empty crop")
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    u, v, w = np.tensordot(_quad_map(q, width, height), np.stack([x, y, np.ones_like(x)]), 1)
    fx, fy = np.rint(u / w * 32).astype(np.int64), np.rint(v / w * 32).astype(np.int64)
    weights = cubic_tables()[fy & 31, fx & 31]
    left, top = (fx >> 5) - 1, (fy >> 5) - 1
    total = np.zeros((height, width, 3), np.int64)
    for j in range(4):
        for i in range(4):
            source = pixels[np.clip(top + j, 0, pixels.shape[0] - 1), np.clip(left + i, 0, pixels.shape[1] - 1)]
            total += source.astype(np.int64) * weights[:, :, j, i, None]
    out = np.clip((total + (1 << 14)) >> 15, 0, 255).astype(np.uint8)
    return np.rot90(out) if 2 * height >= 3 * width else out


def crops(pages: DataFrame) -> DataFrame:
    """image_id, rank, width, height, rgb of each quad of each page; null sizes and rgb where a quad can't be cut.

    ``pages`` has image_id, width, height, rgb and quads (clockwise from top
    left).  A page without pixels, or with other than 3 * width * height of them,
    has no crop that can be cut; null quads give no rows.
    """

    def cut(batches):
        for batch in batches:
            for image, w, h, rgb, quads in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns = [[], [], [], [], []]
                page = None if rgb is None or not w or not h or len(rgb) != 3 * w * h else np.frombuffer(rgb, np.uint8).reshape(h, w, 3)
                for rank, quad in enumerate(quads or ()):
                    try:
                        made = None if page is None else crop(page, [(p["x"], p["y"]) for p in quad])
                    except ValueError:
                        made = None
                    row = (image, rank, None, None, None) if made is None else (image, rank, made.shape[1], made.shape[0], made.tobytes())
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["image_id", "rank", "width", "height", "rgb"])

    columns = pages.select(F.col("image_id").cast("bigint"), F.col("width").cast("int"), F.col("height").cast("int"), "rgb", "quads")
    return columns.mapInArrow(cut, "image_id bigint, rank int, width int, height int, rgb binary")
