"""JPEG headers, orientation and pixels; recognition over JPEG pages; hull and text decoding at page size."""

from __future__ import annotations

import itertools
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlines import schema
from rasterlines.operators import jpeg, png, regions
from rasterlines.operators.recognise import decode_text, recognise
from rasterlines.plans.pages import BrightnessRuntime
from rasterlines.plans.photographs import exif, grey_blocks

LEVELS = np.arange(60, 60 + 3 * 6 * 5, 5).reshape(3, 6)


def seen(levels, orientation):
    """Brightness by block as it is to be seen, from what Exif says the first row and the first column are."""
    rows, columns = levels.shape
    out = np.zeros((rows, columns) if orientation < 5 else (columns, rows), int)
    for y, x in itertools.product(range(rows), range(columns)):
        down, across = {1: (y, x), 2: (y, -1 - x), 3: (-1 - y, -1 - x), 4: (-1 - y, x), 5: (x, y), 6: (x, -1 - y), 7: (-1 - x, -1 - y), 8: (-1 - x, y)}[orientation]
        out[down, across] = levels[y, x]
    return out


def test_turned_pages_are_as_exif_says():
    page = np.repeat(LEVELS[..., None], 3, 2)
    for orientation in range(1, 9):
        assert (jpeg.turned(page, orientation)[..., 0] == seen(LEVELS, orientation)).all()


@pytest.mark.parametrize("big", [False, True])
def test_headers(big):
    for orientation in range(1, 9):
        assert jpeg.header(grey_blocks(LEVELS, exif(orientation, big))) == (48, 24, 1, orientation)
    assert jpeg.header(grey_blocks(LEVELS)) == (48, 24, 1, 1)
    assert jpeg.header(grey_blocks(LEVELS, exif(9, big)))[3] == jpeg.header(grey_blocks(LEVELS, exif(0, big)))[3] == 1


def test_orientation_of_damaged_tiff():
    body = exif(6, True)[10:]
    assert jpeg.exif_orientation(body) == 6
    for n in range(len(body)):
        assert jpeg.exif_orientation(body[:n]) in (1, 6)
    assert jpeg.exif_orientation(b"MM\0*\xff\xff\xff\xff") == 1 and jpeg.exif_orientation(b"XX\0*" + body[4:]) == 1
    for wrong in (struct.pack(">HHIHH", 0x0112, 4, 1, 6, 0), struct.pack(">HHIHH", 0x0112, 3, 2, 6, 0)):
        assert jpeg.exif_orientation(b"MM\0*" + struct.pack(">IH", 8, 1) + wrong) == 1


def test_damaged_headers():
    good = grey_blocks(LEVELS, exif(3, False))
    frame = good.index(b"\xff\xc0")
    bad = [good[:n] for n in range(len(good))] + [good[:-2], good + b"\n", b"\x89PNG" + good, good[:frame] + good[frame + 13 :]]
    bad += [good[: frame + 4] + bytes([12]) + good[frame + 5 :], good[: frame + 5] + bytes(2) + good[frame + 7 :], good[:frame] + 2 * good[frame : frame + 13] + good[frame + 13 :], good[: frame + 1] + b"\xc9" + good[frame + 2 :]]
    for content in bad:
        with pytest.raises(png.ImageError):
            jpeg.header(content)
    assert jpeg.header(good[:2] + b"\xff\xff" + good[2:]) == (48, 24, 1, 3)


def test_rasters(spark):
    good = grey_blocks(LEVELS)
    rows = [(k, grey_blocks(LEVELS, exif(k, k % 2 == 0)), 48, 24, "x") for k in range(1, 9)]
    rows += [(20, good[:-2], 48, 24, "x"), (21, good, 47, 24, "x"), (22, good[:60] + b"\xff\xd9", 48, 24, "x"), (23, None, 48, 24, "x"), (24, b"", 48, 24, "x"), (25, good, None, 24, "x"), (None, good, 48, 24, "x")]
    hollow = good[: good.index(b"\xff\xda") + 10] + b"\xff\xd9"  # a frame without data: no error before decoding
    rows.append((26, hollow, 48, 24, "x"))
    # A frame of 16384 x 16384 pixels is refused by its header alone.
    huge = good.replace(struct.pack(">BHH", 8, 24, 48), struct.pack(">BHH", 8, 16384, 16384))
    rows.append((27, huge, 16384, 16384, "x"))
    found = {r.image_id: r for r in jpeg.rasters(spark.createDataFrame(rows, "image_id bigint, content binary, width int, height int, raster string").repartition(3)).collect()}
    assert len(found) == len(rows)
    for k in [*range(1, 9), None]:
        r, want = found[k].raster, seen(LEVELS, k or 1)
        page = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        assert found[k].error_code is None and (page == np.kron(want, np.ones((8, 8), int))[..., None]).all()
        assert r.orientation_applied == (k not in (None, 1)) and r.source_format == "jpeg"
    assert all(found[k].error_code == "invalid_image" and found[k].raster is None for k in (20, 21, 22, 23, 24, 25, 27))
    assert jpeg.rasters(spark.createDataFrame([], "image_id bigint, content binary, width int, height int")).collect() == []


def test_images_share_a_folder_a_task(spark, tmp_path, monkeypatch):
    good = grey_blocks(LEVELS)
    table = spark.createDataFrame([(k, good, 48, 24) for k in range(-1, 20)], "image_id bigint, content binary, width int, height int").repartition(2)
    want = {k: None for k in range(-1, 20)}
    monkeypatch.setattr(jpeg, "new_folder", lambda _, name: f"file://{tmp_path}/{name}")
    assert {r.image_id: r.error_code for r in jpeg.rasters(table).collect()} == want
    assert len(list((tmp_path / "jpeg").iterdir())) <= 2 and len(list((tmp_path / "jpeg").rglob("*.jpg"))) == 21
    # A store that pyarrow doesn't know: a folder a file.
    monkeypatch.setattr(jpeg, "new_folder", lambda _, name: f"viewfs:///{name}/new")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.default.link./jpeg", f"file://{tmp_path}/other")
    (tmp_path / "other").mkdir()
    assert {r.image_id: r.error_code for r in jpeg.rasters(table.where("image_id < 3")).collect()} == {k: None for k in range(-1, 3)}


def test_colours_come_in_their_order(spark, tmp_path):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(32, 16, 5)
    graphics = image.createGraphics()
    graphics.setColor(jvm.java.awt.Color(200, 40, 90))
    graphics.fillRect(0, 0, 32, 16)
    path = tmp_path / "a.jpg"
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))
    content = path.read_bytes()
    r = jpeg.rasters(spark.createDataFrame([(1, content, 32, 16)], "image_id bigint, content binary, width int, height int")).first().raster
    assert np.abs(np.frombuffer(r.rgb, np.uint8).reshape(-1, 3).astype(int) - [200, 40, 90]).max() <= 3


def test_recognition_of_jpeg_pages(spark):
    levels = np.full((8, 12), 228)
    levels[2, 1:11] = levels[5, 1:8] = 28
    upright = grey_blocks(levels)
    lying = grey_blocks(np.rot90(levels), exif(6, True))
    rows = [(1, upright, "jpeg", len(upright), 96, 64), (2, lying, "jpeg", len(lying), 64, 96), (3, lying, "jpeg", len(lying), 96, 64), (4, upright[:-3], "jpeg", len(upright) - 3, 96, 64)]
    page = png.encode(np.kron(levels, np.ones((8, 8), int))[..., None].repeat(3, 2))
    rows.append((5, page, "png", len(page), 96, 64))
    found = {r.image_id: r for r in recognise(spark.createDataFrame(rows, schema.IMAGES), BrightnessRuntime, list("abcdefg")).collect()}
    assert {k: r.error_code for k, r in found.items()} == {1: None, 2: None, 3: "invalid_image", 4: "invalid_image", 5: None}
    assert found[1].result == found[2].result == found[5].result and len(found[1].result.pages[0].blocks) == 2


def test_hull_of_row_ends_is_that_of_all_pixels():
    rng = np.random.default_rng(4)
    for _ in range(50):
        mask = rng.random((12, 17)) < rng.choice([0.05, 0.3, 0.9])
        pixels = rng.permutation(np.flatnonzero(mask))
        all_ = np.column_stack([pixels % 17, pixels // 17])
        assert (regions.convex_hull(regions.row_ends(pixels, 17)) == regions.convex_hull(all_)).all() if len(pixels) else not len(regions.row_ends(pixels, 17))


def test_a_region_as_large_as_the_page_is_quick():
    p = np.full((960, 960), 0.9, np.float32)
    p[0] = 0
    began = time.perf_counter()
    (pixels,) = regions.label(p > 0.3)
    box = regions.minimum_rectangle(regions.row_ends(pixels, 960))
    took = time.perf_counter() - began
    assert {box["side_a"], box["side_b"]} == {958, 959} and took < 1


def test_decoding_is_linear_behind_a_filter(spark):
    symbols = [chr(33 + k % 90) for k in range(437)]
    steps = 400
    best = "transform(sequence(1, {n}), k -> named_struct('k', cast(k % 437 as int), 'v', float(0.5)))"

    def plan(n):
        read = spark.range(0, 200, 1, 4).select("id", F.expr(best.format(n=n)).alias("best"))
        # What comes out of the network's stage is a column, not an expression.
        read = read.mapInArrow(lambda batches: batches, "id bigint, best array<struct<k:int,v:float>>")
        return decode_text(read, symbols).where("text <> '' and confidence >= 0.1")

    def seconds(n):
        began = time.perf_counter()
        assert plan(n).agg(F.count("*"), F.min(F.length("text"))).first()[:] == (200, n - n // 437)
        return time.perf_counter() - began

    seconds(steps)
    assert min(seconds(4 * steps) for _ in range(2)) < 8 * min(seconds(steps) for _ in range(2)) + 1
