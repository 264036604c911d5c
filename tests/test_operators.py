"""Raster kernels against small exact cases and brute force; the whole path with a stand-in runtime."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from rasterlines.operators import pixels, png, regions
from rasterlines.operators.recognise import recognise
from rasterlines.plans.pages import BrightnessRuntime
from rasterlines.schema import IMAGES


def gradient(width, height):
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([17 * x + 3 * y, 5 * x + 19 * y, 11 * x + 7 * y], 2).astype(np.uint8)


def filtered(pixel_rows, kind):
    out, above = b"", np.zeros_like(pixel_rows[0])
    for row in pixel_rows:
        left = np.concatenate([np.zeros((1, row.shape[1]), np.uint8), row[:-1]])
        upper_left = np.concatenate([np.zeros((1, row.shape[1]), np.uint8), above[:-1]])
        a, b, c = (v.astype(int) for v in (left, above, upper_left))
        p = a + b - c
        paeth = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        guess = [0 * a, a, b, (a + b) // 2, paeth][kind]
        out += bytes([kind]) + ((row.astype(int) - guess) & 255).astype(np.uint8).tobytes()
        above = row
    return out


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_png_filters_and_colour_types(kind, colour):
    import struct

    n = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    rows = np.random.default_rng(kind).integers(0, 256, (5, 7, n), dtype=np.uint8)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    content = png.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(filtered(rows, kind))) + chunk(b"IEND", b"")
    want = rows.astype(int)
    if n in (2, 4):
        want = (want[..., :-1] * want[..., -1:] + 255 * (255 - want[..., -1:]) + 127) // 255
    want = np.repeat(want, 3, 2) if want.shape[2] == 1 else want
    assert (png.decode(content, 10**6) == want).all()


def test_png_rejects_damage():
    good = png.encode(gradient(5, 4))
    assert (png.decode(good, 10**6) == gradient(5, 4)).all()
    for n in range(len(good)):
        with pytest.raises(png.ImageError):
            png.decode(good[:n], 10**6)
    with pytest.raises(png.ImageError):
        png.decode(good, 10)


def test_resize_centre_and_identity():
    page = gradient(4, 4)
    assert pixels.resize(page, 4, 4) is page
    row = np.repeat(((17 * np.arange(80)) % 256).astype(np.uint8)[None, :, None], 3, 2)
    assert pixels.resize(row, 64, 1)[0, :6, 0].tolist() == [2, 23, 45, 66, 87, 108]
    assert pixels.resize(row, 120, 1)[0, :6, 0].tolist() == [0, 9, 20, 31, 43, 54]


def test_crops():
    same = pixels.crop(gradient(5, 4), [(0, 0), (4, 0), (4, 3), (0, 3)])
    assert same.shape == (3, 4, 3) and same[0, 0].tolist() == [0, 0, 0] and same[-1, -1].tolist() == [57, 53, 47]
    tall = pixels.crop(gradient(3, 6), [(0, 0), (2, 0), (2, 5), (0, 5)])
    assert tall.shape == (2, 5, 3) and tall[0, 0].tolist() == [17, 5, 11] and tall[-1, -1].tolist() == [12, 76, 28]


def test_cubic_weights_sum_to_one():
    assert (pixels.cubic_tables().sum((2, 3)) == 32768).all()


def test_recogniser_batch_orders_by_aspect():
    crops = [np.zeros((50, w, 3), np.uint8) for w in (200, 10, 100)]
    batch, order = pixels.recogniser_batch(crops)
    assert order == [1, 2, 0] and batch.shape == (3, 3, 48, 320)
    assert pixels.recogniser_batch([np.zeros((1, 16384, 3), np.uint8)])[0].shape[3] == 3200


def brute_area(points):
    best = None
    for a, b in itertools.permutations(points, 2):
        u = np.subtract(b, a) / np.hypot(*np.subtract(b, a))
        v = np.array([-u[1], u[0]])
        across = [np.dot(np.subtract(p, a), v) for p in points]
        if min(across) > -1e-9 and max(across) > 1e-9:
            along = [np.dot(p, u) for p in points]
            area = (max(along) - min(along)) * max(across)
            best = area if best is None else min(best, area)
    return best


def test_minimum_rectangles_of_all_subsets_of_a_grid():
    grid = list(itertools.product(range(3), range(3)))
    for mask in range(1, 512):
        points = [p for k, p in enumerate(grid) if mask >> k & 1]
        found = regions.minimum_rectangle(np.array(points))
        want = brute_area(points)
        assert (found is None) == (want is None)
        if want is not None:
            assert abs(found["area"] - want) < 1e-9


def test_labels_join_across_corners():
    page = np.zeros((9, 9), bool)
    page[:4, :4] = page[4:8, 4:8] = True
    assert [len(c) for c in regions.label(page)] == [32]
    u = np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1]], bool)
    assert len(regions.label(u)) == 1
    assert regions.label(np.zeros((3, 3), bool)) == []


def test_region_of_a_bright_block(spark):
    from pyspark.sql import functions as F

    p = np.zeros((32, 32), np.float32)
    p[10:18, 8:24] = 0.9
    maps = spark.createDataFrame([(1, 32, 32, p.ravel().tolist())], "image_id bigint, width int, height int, p array<float>")
    one = F.lit(1.0).cast("float")
    r = regions.detect_regions(maps, F.lit(32), F.lit(32), one, one).first()
    assert [(q.x, q.y) for q in r.points] == [(4, 6), (27, 6), (27, 21), (4, 21)]
    assert abs(r.score - 0.9) < 1e-6


def test_candidates_are_capped_before_they_are_filtered(spark):
    p = np.zeros((64, 960), np.float32)
    for k in range(1001):
        x, y = 5 * (k % 190), 5 * (k // 190)
        p[y : y + 4, x : x + 4] = 0.9
    maps = spark.createDataFrame([(1, 960, 64, p.ravel().tolist())], "image_id bigint, width int, height int, p array<float>")
    assert regions.components(maps, 0.3).count() == 1000


def test_whole_path(spark):
    page = np.full((64, 96, 3), 255, np.uint8)
    page[10:20, 8:80] = 0
    page[36:46, 8:60] = 0
    content = png.encode(page)
    rows = [
        (1, content, "png", len(content), 96, 64),
        (2, content, "png", len(content), 96, 63),
        (3, content, "jpeg", len(content), 96, 64),
        (4, content, "png", 0, 96, 64),
        (5, png.encode(np.full((64, 96, 3), 255, np.uint8)), "png", None, 96, 64),
        (6, content[:-1], "png", len(content) - 1, 96, 64),
        (7, None, "png", 5, 96, 64),
    ]
    rows = [r[:3] + (len(r[1]) if r[0] == 5 else r[3],) + r[4:] for r in rows]
    symbols = list("abcdefg")
    found = {r.image_id: r for r in recognise(spark.createDataFrame(rows, IMAGES), BrightnessRuntime, symbols).collect()}
    assert {k: r.error_code for k, r in found.items()} == {1: None, 2: "invalid_image", 3: "invalid_image", 4: "invalid_request", 5: None, 6: "invalid_image", 7: "invalid_image"}
    blocks = found[1].result.pages[0].blocks
    assert len(blocks) == 2 and blocks[0].polygon.points[0].y < blocks[1].polygon.points[0].y
    assert blocks[0].lines[0].words[0].text == blocks[0].lines[0].text
    assert found[5].result.pages[0].blocks == []
    none = recognise(spark.createDataFrame(rows, IMAGES), None, symbols).where("image_id = 1").first()
    assert none.error_code == "model_unavailable" and none.result is None


def test_seventeen_regions_go_in_chunks_of_eight(spark):
    page = np.full((240, 96, 3), 255, np.uint8)
    for k in range(17):
        page[4 + 13 * k : 11 + 13 * k, 6:90] = 0
    content = png.encode(page)
    rows = [(1, content, "png", len(content), 96, 240)]
    r = recognise(spark.createDataFrame(rows, IMAGES), BrightnessRuntime, list("abcdefg")).first()
    tops = [b.polygon.points[0].y for b in r.result.pages[0].blocks]
    assert r.error_code is None and len(tops) == 17 and tops == sorted(tops)
