"""JPEG rasters: headers read from the segments, pixels by Spark's own image source, turned as Exif says.

The JVM's reader decodes pixels but passes neither the orientation on nor
rows by content, so a JPEG is admitted by a walk over its segments first and then
written to a file of its own; id and orientation are the file's name
and come back as the origin beside the pixels, without a join.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema
from ..sources.shared import limit_batches, new_folder
from .png import ImageError

# Fixed values of the format: markers without a body, frames that have sizes, the tag of the orientation.
_ALONE = {0x01, *range(0xD0, 0xD8)}
_FRAMES = {0xC0, 0xC1, 0xC2}
_OTHER_FRAMES = {0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)}
_SCAN, _END, _APP1 = 0xDA, 0xD9, 0xE1
_ORIENTATION, _SHORT = 0x0112, 3

HEADER = "struct<width:int,height:int,channels:int,orientation:int>"
_HEADER_ARROW = pa.struct([(n, pa.int32()) for n in ("width", "height", "channels", "orientation")])


def exif_orientation(body: bytes) -> int:
    """Orientation (1 to 8) of a TIFF structure; 1 where it has none or is damaged."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(body[:4])
    if order is None or len(body) < 8:
        return 1
    (at,) = struct.unpack_from(f"{order}I", body, 4)
    if at + 2 > len(body):
        return 1
    (n,) = struct.unpack_from(f"{order}H", body, at)
    for entry in range(at + 2, min(at + 2 + 12 * n, len(body) - 11), 12):
        tag, kind, count, value = struct.unpack_from(f"{order}HHIH", body, entry)
        if tag == _ORIENTATION:
            return value if kind == _SHORT and count == 1 and 1 <= value <= 8 else 1
    return 1


def header(content: bytes) -> tuple[int, int, int, int]:
    """(width, height, channels, orientation) of a JPEG, from the segments before its first scan.

    An error where the content doesn't begin and end as a JPEG does, a segment
    is cut off, no frame of 8-bit samples comes before the scan, or there are two.
    """
    if content[:3] != b"\xff\xd8\xff" or content[-2:] != b"\xff\xd9":
        raise ImageError("signature")
    at, frame, orientation = 2, None, None
    while True:
        if at + 2 > len(content) or content[at] != 0xFF:
            raise ImageError("marker")
        marker = content[at + 1]
        at += 1 if marker == 0xFF else 2  # fill bytes may come before a marker
        if marker == 0xFF or marker in _ALONE:
            continue
        if marker in _OTHER_FRAMES or marker == _END or at + 2 > len(content):
            raise ImageError("segment")
        (size,) = struct.unpack_from(">H", content, at)
        body = content[at + 2 : at + size]
        if size < 2 or len(body) != size - 2:
            raise ImageError("segment")
        at += size
        if marker == _SCAN:
            break
        if marker in _FRAMES:
            if frame or len(body) < 6 or body[0] != 8:
                raise ImageError("frame")
            height, width, channels = struct.unpack_from(">HHB", body, 1)
            frame = width, height, channels
        elif marker == _APP1 and body[:6] == b"Exif\0\0" and orientation is None:
            orientation = exif_orientation(body[6:])
    if frame is None or not frame[0] or not frame[1] or frame[2] not in (1, 3):
        raise ImageError("frame")
    return *frame, orientation or 1


def turned(page: np.ndarray, orientation: int) -> np.ndarray:
    """The page as it is to be seen: orientations 2, 4, 5 and 7 are mirrored, 5 to 8 lie on their sides."""
    if orientation in (5, 7):
        page = page.transpose(1, 0, 2)
    if orientation in (6, 8):
        page = np.rot90(page, 1 if orientation == 8 else -1)
    if orientation == 2:
        page = page[:, ::-1]
    if orientation == 4:
        page = page[::-1]
    return np.rot90(page, 2) if orientation in (3, 7) else page


def with_headers(images: DataFrame, column: str = "content") -> DataFrame:
    """Adds ``header`` (width, height, channels, orientation); null where the content is null or no whole JPEG."""
    at = images.columns.index(column)

    def read(batches):
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                content = batch.column(at)[k].as_py()
                try:
                    found.append(dict(zip(("width", "height", "channels", "orientation"), header(content or b""), strict=True)))
                except ImageError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _HEADER_ARROW)], [*batch.schema.names, "header"])

    return images.mapInArrow(read, StructType([*images.schema.fields, *StructType.fromDDL(f"header {HEADER}").fields]))


def size_admitted(width, height):
    """Whether sides, pixels and RGB bytes are within the limits."""
    area = width.cast("bigint") * height.cast("bigint")
    return (width > 0) & (height > 0) & (width <= schema.MAX_SIDE) & (height <= schema.MAX_SIDE) & (area <= schema.MAX_PIXELS) & (area * 3 <= schema.MAX_DECODED_BYTES)


def _written(files: DataFrame, folder: str) -> list[str]:
    """Writes each row (jpeg, content) to a file of that name; gives the folders to read.

    Each attempt of a task has a folder of its own, and only those of tasks that
    ended well are read.  Where ``pyarrow.fs`` doesn't know the store, Spark's text
    writer makes a folder for each file, which is much slower.
    """
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        # A text file of one row holds its bytes unchanged and a line feed after the end marker, which no decoder reads.
        files.select("jpeg", F.col("content").cast("string").alias("value")).write.partitionBy("jpeg").text(folder)
        return [folder] if files.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").where("path like '%/jpeg=%'").limit(1).count() else []

    def write(batches):
        system, root = fs.FileSystem.from_uri(folder)
        own, n = uuid.uuid4().hex, 0
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                if not n:
                    system.create_dir(f"{root}/{own}", recursive=True)
                with system.open_output_stream(f"{root}/{own}/{name}.jpg") as out:
                    out.write(content.as_buffer())
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([own])], ["own"])

    return [f"{folder}/{r.own}" for r in files.mapInArrow(write, "own string").collect()]  # a row for each task


def rasters(images: DataFrame) -> DataFrame:
    """image_id, error_code, raster of JPEG images (image_id, content, width, height; image_ids are distinct).

    ``invalid_image``: no whole JPEG, other sizes than declared, sizes beyond the limits
    before or after turning, or pixels that can't be decoded.  Null content is
    one of these; a null image_id stays null.  Other columns are ignored.
    """
    spark = images.sparkSession
    given = with_headers(images.select(F.col("image_id").cast("bigint"), "content", "width", "height"))
    h = F.col("header")
    fine = (h["width"] == F.col("width")) & (h["height"] == F.col("height")) & size_admitted(h["width"], h["height"])
    given = given.withColumn("fine", F.coalesce(fine, F.lit(False)))
    limit_batches(spark)
    name = F.concat(F.lit("o"), h["orientation"], F.lit("-"), F.coalesce(F.col("image_id").cast("string"), F.lit("")))
    folders = _written(given.where("fine").select(name.alias("jpeg"), "content"), new_folder(spark, "jpeg"))
    rejected = given.where("not fine").select("image_id", F.lit("invalid_image").alias("error_code"), F.lit(None).cast(schema.RASTER).alias("raster"))
    if not folders:
        return rejected
    # One listing task for many folders, not one for each.
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(2 * spark.sparkContext.defaultParallelism))
    try:
        found = spark.read.format("image").option("dropInvalid", "false").load(folders)
    finally:
        spark.conf.set(key, before)
    part = lambda k: F.regexp_extract("image.origin", r"/(?:jpeg=)?o([1-8])-(-?[0-9]*)[./][^/]*\z", k)
    columns = found.select(part(2).try_cast("bigint").alias("image_id"), part(1).cast("int").alias("orientation"), "image.width", "image.height", "image.nChannels", "image.data")

    def turn(batches):
        raster = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary()), ("source_format", pa.string()), ("orientation_applied", pa.bool_())])
        for batch in batches:
            for k in range(batch.num_rows):  # one image at a time: a page takes up to 192 MiB
                image, orientation, w, height, n, data = (c[k].as_py() for c in batch.columns)
                made = None
                if n in (1, 3) and w > 0 and height > 0:
                    page = np.frombuffer(data, np.uint8).reshape(height, w, n)
                    page = turned(np.repeat(page, 3, 2) if n == 1 else page[..., ::-1], orientation)  # the source has blue first
                    made = {"width": page.shape[1], "height": page.shape[0], "rgb": page.tobytes(), "source_format": "jpeg", "orientation_applied": orientation != 1}
                yield pa.RecordBatch.from_arrays([pa.array([image], pa.int64()), pa.array([made], raster)], ["image_id", "raster"])

    decoded = columns.mapInArrow(turn, f"image_id bigint, raster {schema.RASTER}")
    sound = F.coalesce(size_admitted(F.col("raster.width"), F.col("raster.height")), F.lit(False))
    decoded = decoded.select("image_id", F.when(~sound, "invalid_image").alias("error_code"), F.when(sound, F.col("raster")).alias("raster"))
    return decoded.unionByName(rejected)
