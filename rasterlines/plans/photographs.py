"""JPEG images made from the embeddings: orientation, sizes and damage."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jpeg
from ..sources.shared import in_groups

#: Blocks of 8 x 8 pixels of one brightness, across and down.
ACROSS, DOWN = 16, 4


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def exif(orientation: int, big: bool) -> bytes:
    """An Exif segment whose second entry is the orientation."""
    order = ">" if big else "<"
    entries = struct.pack(f"{order}HHIHH", 0x0100, 3, 1, 77, 0) + struct.pack(f"{order}HHIHH", 0x0112, 3, 1, orientation, 0)
    return _segment(0xE1, b"Exif\0\0" + (b"MM\0*" if big else b"II*\0") + struct.pack(f"{order}IH", 8, 2) + entries + bytes(4))


def grey_blocks(levels: np.ndarray, extra: bytes = b"") -> bytes:
    """A JPEG of down x across blocks, each of one brightness: every block is its mean alone, so it decodes exactly."""
    tables = _segment(0xDB, bytes([0] + [8] * 64))
    means = _segment(0xC4, bytes([0x00, 0, 0, 0, 12] + [0] * 12) + bytes(range(12)))  # categories 0 to 11 in four bits each
    rest = _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0]))  # one bit: nothing but the mean
    frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * levels.shape[0], 8 * levels.shape[1], 1) + bytes([1, 0x11, 0]))
    bits, before = [], 0
    for level in (levels.astype(int) - 128).ravel().tolist():
        step, before = level - before, level
        n = abs(step).bit_length()
        bits.append(f"{n:04b}" + (f"{step if step > 0 else step + (1 << n) - 1:0{n}b}" if n else "") + "0")
    line = "".join(bits)
    line += "1" * (-len(line) % 8)
    data = int(line, 2).to_bytes(len(line) // 8, "big").replace(b"\xff", b"\xff\0")
    return b"\xff\xd8" + extra + tables + frame + means + rest + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + data + b"\xff\xd9"


def generated_photographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each embedding, its numbers as grey blocks; orientations 0 (none) to 8, both byte orders, some cut off or with a wrong width."""

    def draw(batches):
        def drawn(batch):
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = v.as_py()
                levels = np.clip(np.floor(np.array(v, float) * 256), -100, 100).reshape(DOWN, ACROSS) + 128
                made = grey_blocks(levels, exif(i % 9, i % 2 == 1) if i % 9 else b"")
                yield i, made[:-9] if i % 50 == 7 else made

        for group in in_groups(item for batch in batches for item in drawn(batch)):
            ids, contents = zip(*group, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(contents, pa.binary())], ["image_id", "content"])

    # Each image becomes a file of its own further on: as many writers as there are partitions.
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").repartition(2 * spark.sparkContext.defaultParallelism)
    d = e.mapInArrow(draw, "image_id bigint, content binary")
    return d.select("image_id", "content", F.lit("jpeg").alias("format"), F.octet_length("content").cast("bigint").alias("encoded_bytes"), F.when(F.col("image_id") % 50 == 9, 127).otherwise(8 * ACROSS).alias("width"), F.lit(8 * DOWN).alias("height"))


def jpeg_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, turning and a position-weighted sum of the pixels of each photograph as it is to be seen."""
    found = jpeg.rasters(generated_photographs(spark, sf_dir))

    def sums(batches):
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c) for c in (4, 2, 3)), strict=True):
                rgb, w, h = (x.as_py() for x in row)
                if rgb is None:
                    out.append(None)
                    continue
                page = np.frombuffer(rgb, np.uint8).reshape(h, w, 3).astype(np.int64)
                y, x = np.mgrid[0:h, 0:w] // 8
                out.append(int((page * (1 + x + 100 * y)[..., None]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5), pa.array(out, pa.int64())], ["image_id", "error_code", "width", "height", "turned", "weighted"])

    d = found.select("image_id", "error_code", "raster.width", "raster.height", "raster.rgb", F.col("raster.orientation_applied").alias("turned"))
    return d.mapInArrow(sums, "image_id bigint, error_code string, width int, height int, turned boolean, weighted bigint")


def jpeg_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, channels and orientation from the segments alone, without decoding."""
    d = jpeg.with_headers(generated_photographs(spark, sf_dir))
    return d.select("image_id", F.col("header.width").alias("w"), F.col("header.height").alias("h"), F.col("header.channels").alias("channels"), F.col("header.orientation").alias("orientation"))


QUERIES = {"jpeg_orientation": jpeg_orientation, "jpeg_headers": jpeg_headers}

QUERIES_SQL = {
    "jpeg_orientation": f"""WITH p AS (SELECT vec_id, vec_id % 9 AS o, vec_id % 50 NOT IN (7, 9) AS ok,
        list_transform(embedding, lambda x: (128 + greatest(-100, least(100, floor(x::DOUBLE * 256))))::BIGINT) AS v FROM embeddings),
      b AS (SELECT vec_id, o, v[(k + 1)::INT] AS level, k % {ACROSS} AS x, k // {ACROSS} AS y FROM p, range({ACROSS * DOWN}) r(k) WHERE ok),
      t AS (SELECT vec_id, level, CASE WHEN o IN (2, 3) THEN {ACROSS - 1} - x WHEN o IN (0, 1, 4) THEN x WHEN o IN (5, 8) THEN y ELSE {DOWN - 1} - y END AS x,
        CASE WHEN o IN (3, 4) THEN {DOWN - 1} - y WHEN o IN (0, 1, 2) THEN y WHEN o IN (5, 6) THEN x ELSE {ACROSS - 1} - x END AS y FROM b),
      s AS (SELECT vec_id, sum(level * 64 * 3 * (1 + x + 100 * y))::BIGINT AS weighted FROM t GROUP BY vec_id)
      SELECT vec_id AS image_id, CASE WHEN ok THEN NULL ELSE 'invalid_image' END AS error_code, CASE WHEN ok THEN CASE WHEN o < 5 THEN {8 * ACROSS} ELSE {8 * DOWN} END END AS width,
        CASE WHEN ok THEN CASE WHEN o < 5 THEN {8 * DOWN} ELSE {8 * ACROSS} END END AS height, CASE WHEN ok THEN o > 1 END AS turned, weighted FROM p LEFT JOIN s USING (vec_id)""",
    "jpeg_headers": f"""SELECT vec_id AS image_id, CASE WHEN ok THEN {8 * ACROSS} END AS w, CASE WHEN ok THEN {8 * DOWN} END AS h, CASE WHEN ok THEN 1 END AS channels, CASE WHEN ok THEN greatest(1, vec_id % 9)::INTEGER END AS orientation
      FROM (SELECT *, vec_id % 50 <> 7 AS ok FROM embeddings)""",
}
