"""The whole path from encoded pages to validated results, as Spark stages.

``detect`` and ``read_regions`` are the only stages that touch pixels; both work
on Arrow batches with the runtime made once a task.  Between them regions are
ordered and checked by column expressions where they are; after them text is
decoded, filtered, nested and validated by column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import admission as A
from ..functions import geometry as G
from ..functions import recognition as R
from . import jpeg, pixels, png
from .regions import REGIONS, REGIONS_ARROW, as_structs, regions_of_map
from .runtime import TensorRuntime

Factory = Callable[[], TensorRuntime]


def admit(images: DataFrame) -> DataFrame:
    """Adds error_code: invalid_request for metadata, invalid_image for content that contradicts it; null if fine."""
    request = A.metadata_error(F.col("encoded_bytes"), F.col("width"), F.col("height"))
    content = F.coalesce((F.octet_length("content") == F.col("encoded_bytes")) & (A.sniffed_format(F.col("content")) == F.col("format")), F.lit(False))
    return images.withColumn("error_code", F.coalesce(request, F.when(~content, "invalid_image")))


def _page(content: bytes | None, rgb: bytes | None, width: int, height: int) -> np.ndarray:
    """Height x width x 3 bytes, of pixels given or of a PNG."""
    page = png.decode(content, schema.MAX_DECODED_BYTES) if rgb is None else np.frombuffer(rgb, np.uint8).reshape(height, width, 3)
    if page.shape[:2] != (height, width):
        raise png.ImageError("size")
    return page


def detect(images: DataFrame, runtime: Factory, threshold: float = 0.3, box_threshold: float = 0.6, min_side: float = 3, min_grown_side: float = 5, ratio: float = 1.5) -> DataFrame:
    """image_id, content, rgb, page_width, page_height, error_code, regions of each image; its map doesn't leave the stage.

    ``rgb`` are the image's pixels, or null and ``content`` is a PNG.

    A map of another size than the tensor's, or with values that are not
    finite or beyond [0, 1], is an internal error.
    """

    def find(model, content, rgb, w, h) -> tuple[str | None, list]:
        try:
            page = _page(content, rgb, w, h)
        except png.ImageError:
            return "invalid_image", []
        tensor, sx, sy = pixels.detector_tensor(page)
        p = np.asarray(model.detect(tensor))
        if p.shape != tensor.shape[2:] or not np.isfinite(p).all() or p.min() < 0 or p.max() > 1:
            return "internal", []
        return None, as_structs(regions_of_map(p, (w, h), (sx, sy), threshold, box_threshold, min_side, min_grown_side, ratio))

    def run(batches):
        model = runtime()
        for batch in batches:
            for k in range(batch.num_rows):  # one image at a time: a page takes up to 192 MiB
                row = batch.slice(k, 1)
                error, found = find(model, *(row.column(c)[0].as_py() for c in range(1, 5)))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([error], pa.string()), pa.array([found], REGIONS_ARROW)], ["image_id", "content", "rgb", "page_width", "page_height", "error_code", "regions"])

    columns = images.select(F.col("image_id").cast("bigint"), "content", "rgb", "width", "height")
    return columns.mapInArrow(run, f"image_id bigint, content binary, rgb binary, page_width int, page_height int, error_code string, regions {REGIONS}")


def in_reading_order(pages: DataFrame) -> DataFrame:
    """``ordered``, the regions as read, beside the page's error if one crop cannot be cut; rows stay where they are."""
    item = lambda r: F.struct(r["points"][0]["y"].alias("y"), r["points"][0]["x"].alias("x"), r["component"].alias("i"), r["points"].alias("points"))
    fine = F.forall("regions", lambda r: G.strictly_convex(r["points"]) & G.inside(r["points"], F.col("page_width"), F.col("page_height")))
    area = F.aggregate("regions", F.lit(0).cast("bigint"), lambda a, r: a + G.crop_width(r["points"]).cast("bigint") * G.crop_height(r["points"]))
    error = F.when(area > schema.MAX_CROP_PIXELS, "overloaded").when(~fine, "invalid_image")
    checked = pages.withColumn("error_code", F.coalesce("error_code", error)).withColumn("items", F.transform("regions", item)).drop("regions")
    return checked.withColumn("ordered", G.reading_order("items")).drop("items")


_READ = f"image_id bigint, page_width int, page_height int, error_code string, rank int, points array<{schema.POINT}>, best array<struct<k:int,v:float>>"


def read_regions(pages: DataFrame, runtime: Factory, classes: int) -> DataFrame:
    """image_id, page size, error_code, rank, points, best of each region, and a row without rank for each page.

    ``best`` has the first class of the largest score at each step, and that score: the scores themselves stay in the stage.

    Crops go through the network in chunks of eight, within one image.  Scores
    of another shape than crops x steps x ``classes``, not finite, beyond
    [0, 1] or of rows that don't sum to 1 make the page an internal error.
    """

    def best_of(model, page, quads):
        for at in range(0, len(quads), schema.CHUNK):
            crops = [pixels.crop(page, quad) for quad in quads[at : at + schema.CHUNK]]
            tensor, order = pixels.recogniser_batch(crops)
            found = np.asarray(model.recognise(tensor))
            good = found.ndim == 3 and found.shape[0] == len(crops) and found.shape[1] and found.shape[2] == classes and np.isfinite(found).all() and found.min() >= 0 and found.max() <= 1
            if not good or np.abs(found.sum(2) - 1).max() > schema.ROW_SUM_TOLERANCE:
                raise ValueError("scores")
            first = found.argmax(2)
            largest = np.take_along_axis(found, first[..., None], 2)[..., 0].astype(np.float32)
            for row, k in enumerate(order):
                yield at + k, [{"k": c, "v": v} for c, v in zip(first[row].tolist(), largest[row].tolist(), strict=True)]

    def run(batches):
        model = runtime()
        point = pa.list_(pa.struct([("x", pa.float32()), ("y", pa.float32())]))
        for batch in batches:
            for k in range(batch.num_rows):
                image, content, rgb, w, h, error, points = (batch.column(c)[k].as_py() for c in range(7))
                rows = []
                if error is None:
                    try:
                        page = _page(content, rgb, w, h) if points else None
                        rows = list(best_of(model, page, [[(p["x"], p["y"]) for p in quad] for quad in points]))
                    except ValueError:
                        error = "internal"
                columns = [[image], [w], [h], [error], [None], [None], [None]]
                for rank, best in rows if error is None else ():
                    for column, value in zip(columns, (image, w, h, None, rank, points[rank], best), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), point, pa.list_(pa.struct([("k", pa.int32()), ("v", pa.float32())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["image_id", "page_width", "page_height", "error_code", "rank", "points", "best"])

    return pages.select("image_id", "content", "rgb", "page_width", "page_height", "error_code", F.col("ordered.points").alias("points")).mapInArrow(run, _READ)


def decode_text(read: DataFrame, symbols: list[str]) -> DataFrame:
    """Adds text and confidence in place of ``best``, which is a column of its own: a filter on the text evaluates no scores again."""
    d = read.withColumn("steps", R.emitted("best"))
    return d.withColumns({"text": R.ctc_text("steps", F.array(*map(F.lit, symbols))), "confidence": R.ctc_confidence("steps")}).drop("best", "steps")


def assemble(lines: DataFrame, include_words: bool) -> DataFrame:
    """image_id, page size, error_code and blocks, one for each line, in rank order; a row without rank stands for its page."""
    polygon = F.struct(F.col("points"))
    word = F.array(F.struct("text", "confidence", polygon.alias("polygon")))
    line = F.struct("text", "confidence", polygon.alias("polygon"), (word if include_words else F.filter(word, lambda _: F.lit(False))).alias("words"))
    block = F.struct(polygon.alias("polygon"), F.array(line).alias("lines"))
    nested = lines.withColumn("block", F.when(F.col("rank").isNotNull(), F.struct("rank", block.alias("block")))).groupBy("image_id").agg(F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"), F.max("error_code").alias("error_code"), F.array_sort(F.collect_list("block")).alias("b"))
    return nested.withColumn("blocks", F.col("b.block").cast(f"array<{schema.BLOCK}>")).drop("b")


def page_admitted(blocks: str, width: str, height: str):
    """Whether a page holds: texts of printable ASCII, confidences in [0, 1], polygons inside it of positive area, blocks in reading order."""
    q = lambda b: b["polygon"]["points"]
    sound = F.forall(blocks, lambda b: G.inside(q(b), F.col(width), F.col(height), last=0) & (G.double_area(q(b)) > 0) & F.forall(b["lines"], lambda x: R.text_admitted(x["text"]) & ~F.isnan(x["confidence"]) & x["confidence"].between(0, 1)))
    return (F.col(width) > 0) & (F.col(height) > 0) & sound


def recognise(images: DataFrame, runtime: Factory | None, symbols: list[str], minimum_confidence: float = 0.0, include_words: bool = True, **detection) -> DataFrame:
    """image_id, error_code, result (one page; null with an error) of each image row; image_ids are distinct.

    ``symbols`` are the characters of classes 1, 2, ...; without a runtime every
    admitted image is ``model_unavailable``.  Lines of low confidence or
    without text are left out, and a page whose other lines are then no longer
    in reading order is ``internal``.  JPEG images are decoded and turned once, into
    pixels; a PNG is decoded twice, for the two networks, of which each sees a page
    once; only text is shuffled.
    """
    admitted = admit(images)
    rejected = admitted.where("error_code is not null").select("image_id", "error_code")
    good = admitted.where("error_code is null").drop("error_code")
    kind = schema.RESULT
    if runtime is None:
        none = good.select("image_id", F.lit("model_unavailable").alias("error_code"))
        return rejected.unionByName(none).withColumn("result", F.lit(None).cast(kind))
    photographs = jpeg.rasters(good.where("format = 'jpeg'"))
    rejected = rejected.unionByName(photographs.where("error_code is not null").select("image_id", "error_code"))
    turned = photographs.where("error_code is null").select("image_id", F.lit(None).cast("binary").alias("content"), F.col("raster.rgb").alias("rgb"), F.col("raster.width").alias("width"), F.col("raster.height").alias("height"))
    drawn = good.where("format = 'png'").select("image_id", "content", F.lit(None).cast("binary").alias("rgb"), "width", "height")
    pages = in_reading_order(detect(drawn.unionByName(turned), runtime, **detection))
    lines = decode_text(read_regions(pages, runtime, len(symbols) + 1), symbols)
    kept = lines.where(F.col("rank").isNull() | ((F.col("text") != "") & (F.col("confidence") >= F.lit(minimum_confidence).cast("float"))))
    out = assemble(kept, include_words)
    corner = F.expr("transform(blocks, (b, i) -> named_struct('y', b.polygon.points[0].y, 'x', b.polygon.points[0].x, 'i', i))")
    out = out.withColumn("corners", corner).withColumn("again", G.reading_order("corners"))
    fine = page_admitted("blocks", "page_width", "page_height") & (F.col("again") == F.col("corners"))
    error = F.coalesce("error_code", F.when(~F.coalesce(fine, F.lit(False)), "internal"))
    page = F.struct(F.lit(0).alias("index"), F.col("page_width").alias("width"), F.col("page_height").alias("height"), "blocks")
    done = out.select("image_id", error.alias("error_code"), F.struct(F.array(page).alias("pages")).cast(kind).alias("result")).withColumn("result", F.when(F.col("error_code").isNull(), F.col("result")))
    return done.unionByName(rejected.withColumn("result", F.lit(None).cast(kind)))
