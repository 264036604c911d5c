"""End-to-end queries over generated pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import png
from ..operators.recognise import recognise
from ..sources.shared import in_groups, limit_batches
from .recognition import SYMBOLS

#: Pages drawn at a time.
GROUP = 256


class BrightnessRuntime:
    """Stands in for the two networks, which this library doesn't hold: dark pixels are text, a column's darkness picks its symbol."""

    def __init__(self, classes: int = 8):
        self.classes = classes

    def detect(self, tensor: np.ndarray) -> np.ndarray:
        return (tensor[0].mean(0) < 0).astype(np.float32) * np.float32(0.9)

    def recognise(self, batch: np.ndarray) -> np.ndarray:
        steps = batch.mean((1, 2)).reshape(len(batch), -1, 8).mean(2)
        best = np.clip(((1 - steps) / 2 * self.classes).astype(int), 0, self.classes - 1)
        out = np.full((*best.shape, self.classes), np.float32(0.1 / (self.classes - 1)))
        np.put_along_axis(out, best[..., None], np.float32(0.9), 2)
        return out


def generated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each embedding: white, with a dark bar for each of its eight rows whose mean is above zero."""

    def draw(batches):
        def drawn(batch):
            for i, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = np.full((128, 96, 3), 255, np.uint8)
                for k, mean in enumerate(np.array(values.as_py(), np.float32).reshape(8, 8).mean(1)):
                    if mean > 0:
                        page[16 * k + 3 : 16 * k + 11, 8 : 60 + 4 * k] = 40 * (k % 3)
                yield i, png.encode(page)

        for group in in_groups((item for batch in batches for item in drawn(batch)), count=GROUP):
            ids, contents = zip(*group, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(contents, pa.binary())], ["image_id", "content"])

    # A small file gives few tasks, a page much work.
    limit_batches(spark)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").repartition(2 * spark.sparkContext.defaultParallelism)
    d = e.mapInArrow(draw, "image_id bigint, content binary")
    return d.select("image_id", "content", F.lit("png").alias("format"), F.octet_length("content").cast("bigint").alias("encoded_bytes"), F.lit(96).alias("width"), F.when(F.col("image_id") % 50 == 7, 127).otherwise(128).alias("height"))


def png_roundtrip_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the whole path; pages that declare a wrong height are errors."""
    done = recognise(generated_pages(spark, sf_dir), BrightnessRuntime, SYMBOLS)
    lines = F.flatten(F.transform(F.col("result")["pages"][0]["blocks"], lambda b: b["lines"]))
    return done.select("image_id", "error_code", F.size(lines).cast("bigint").alias("n_lines"), F.array_join(lines["text"], "|").alias("text"))


QUERIES = {"png_roundtrip_ocr": png_roundtrip_ocr}
QUERIES_SQL: dict[str, str] = {}
