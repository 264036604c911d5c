"""Image rows from lines of JSON and from files, with the schema that recognition reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import admission as A


def requests(lines: DataFrame, *keep: str) -> DataFrame:
    """image_id, content, format, encoded_bytes, width, height, options and error_code of JSON requests.

    ``lines`` has id and value, one document a row.  What is no JSON document of
    the right shape, or has no canonical base64, is ``invalid_request`` without
    content; options left out are English, with words, and confidence 0.
    Null values are invalid; repeated rows stay; other columns than ``keep`` are ignored.
    """
    found = lines.select(*keep, F.col("id").cast("bigint").alias("image_id"), F.from_json("value", schema.REQUEST).alias("r"))
    metadata, options = F.col("r.metadata"), F.col("r.options")
    content = A.strict_base64(F.col("r.image_base64"))
    width, height = (F.when(metadata[c].between(0, 2**31 - 1), metadata[c]).cast("int") for c in ("width", "height"))
    confidence = F.coalesce(options["minimum_confidence"], F.lit(0.0).cast("float"))
    language = F.coalesce(options["language"], F.lit("english"))
    fine = content.isNotNull() & metadata["format"].isin("png", "jpeg") & (language == "english") & confidence.between(0, 1)
    return found.select(
        *keep,
        "image_id",
        content.alias("content"),
        metadata["format"].alias("format"),
        metadata["encoded_bytes"].alias("encoded_bytes"),
        width.alias("width"),
        height.alias("height"),
        F.struct(language.alias("language"), F.coalesce(options["include_words"], F.lit(True)).alias("include_words"), confidence.alias("minimum_confidence")).alias("options"),
        F.when(~F.coalesce(fine, F.lit(False)), "invalid_request").alias("error_code"),
    )


def image_files(spark: SparkSession, path: str, most: int = schema.MAX_ENCODED_BYTES) -> DataFrame:
    """path, content, format (by signature) and encoded_bytes of the files of 1 to ``most`` bytes below a path.

    The bound on the length is pushed to the source: larger files aren't opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.col("length").between(1, most))
    return files.select("path", "content", A.sniffed_format(F.col("content")).alias("format"), F.col("length").alias("encoded_bytes"))


def raw_requests(rows: DataFrame) -> DataFrame:
    """image_id, content, format, encoded_bytes, width, height, options and error_code of requests whose body is the image.

    ``rows`` has id, headers (map of texts; names in any case, of repeated ones
    the first counts) and body.  Format, content type and sizes are needed; words are included and
    any confidence will do unless headers say otherwise.  What is missing or can't be read
    is ``invalid_request``, and only the body's size stays.  Null maps and bodies are invalid; other columns are ignored.
    """
    names = F.transform(F.map_keys("headers"), F.lower)
    header = lambda name: F.get(F.map_values("headers"), F.array_position(names, name).cast("int") - 1)
    format_ = header("x-image-format")
    kind = F.create_map(F.lit("png"), F.lit("image/png"), F.lit("jpeg"), F.lit("image/jpeg"))
    # Unsigned numbers of 32 bits; a plus sign may come before.
    size = lambda name: F.when(header(name).rlike(r"\A\+?[0-9]+\z"), header(name).try_cast("decimal(38,0)"))
    width, height = (F.when(size(n).between(0, 2**31 - 1), size(n)).cast("int") for n in ("x-image-width", "x-image-height"))
    words = F.when(header("x-include-words").isNull(), True).when(header("x-include-words") == "true", True).when(header("x-include-words") == "false", False)
    said = header("x-minimum-confidence")
    number = F.when(said.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), said.try_cast("float"))
    confidence = F.when(said.isNull(), F.lit(0.0).cast("float")).otherwise(F.when(number.between(0, 1), number))
    fine = F.coalesce((header("content-type") == kind[format_]) & width.isNotNull() & height.isNotNull() & words.isNotNull() & confidence.isNotNull() & F.col("body").isNotNull(), F.lit(False))
    keep = lambda c: F.when(fine, c)
    return rows.select(
        F.col("id").cast("bigint").alias("image_id"),
        keep(F.col("body")).alias("content"),
        keep(format_).alias("format"),
        F.octet_length("body").cast("bigint").alias("encoded_bytes"),
        keep(width).alias("width"),
        keep(height).alias("height"),
        keep(F.struct(F.lit("english").alias("language"), words.alias("include_words"), confidence.alias("minimum_confidence"))).alias("options"),
        F.when(~fine, "invalid_request").alias("error_code"),
    )

def proto_requests(rows: DataFrame) -> DataFrame:
    """image_id, content, format, encoded_bytes, width, height, options and error_code of requests as decoded from protobuf.

    ``rows`` has id, image, metadata (format: 1 png, 2 jpeg; encoded_bytes, width,
    height) and options (language, include_words, minimum_confidence).  Without
    options English, with words, any confidence; where the message is there, a
    field left out is zero, false or empty, so a language has to be named.  Without
    metadata, with another format, language or confidence it is ``invalid_request``,
    and nothing else stays.  A null image is empty; other columns are ignored.
    """
    m, o = F.col("metadata"), F.col("options")
    format_ = F.when(m["format"] == 1, "png").when(m["format"] == 2, "jpeg")
    zero = lambda c: F.coalesce(c, F.lit(0))
    present = o.isNotNull()
    language = F.when(present, F.coalesce(o["language"], F.lit(""))).otherwise("english")
    words = F.when(present, F.coalesce(o["include_words"], F.lit(False))).otherwise(True)
    confidence = F.when(present, zero(o["minimum_confidence"]).cast("float")).otherwise(F.lit(0.0).cast("float"))
    sizes = [zero(m[c]).cast("bigint") for c in ("width", "height")]
    fine = F.coalesce(m.isNotNull() & format_.isNotNull() & (language == "english") & ~F.isnan(confidence) & confidence.between(0, 1) & sizes[0].between(0, 2**31 - 1) & sizes[1].between(0, 2**31 - 1), F.lit(False))
    keep = lambda c: F.when(fine, c)
    return rows.select(
        F.col("id").cast("bigint").alias("image_id"),
        keep(F.coalesce("image", F.lit(b""))).alias("content"),
        keep(format_).alias("format"),
        keep(zero(m["encoded_bytes"]).cast("bigint")).alias("encoded_bytes"),
        *(keep(c).cast("int").alias(n) for c, n in zip(sizes, ("width", "height"), strict=True)),
        keep(F.struct(language.alias("language"), words.alias("include_words"), confidence.alias("minimum_confidence"))).alias("options"),
        F.when(~fine, "invalid_request").alias("error_code"),
    )

def batch_requests(lines: DataFrame, most: int = schema.MAX_BATCH_ITEMS, most_bytes: int = schema.MAX_BATCH_BYTES) -> DataFrame:
    """batch_id, position and the columns of ``requests`` for each item of batches; batch_error_code is the batch's.

    ``lines`` has id and value, a JSON document ``{"items": [...]}`` a row; ids are
    distinct.  A batch is taken whole or not at all: without 1 to ``most`` items,
    with one that is invalid or more than ``most_bytes`` of images together, it is
    ``invalid_request`` and its items come without content.  What is no such
    document has one row, without position.  Other columns are ignored.
    """
    document = F.from_json("value", f"items array<struct<{schema.REQUEST}>>")
    items = lines.select(F.col("id").cast("bigint").alias("batch_id"), document.alias("d")).select("batch_id", F.posexplode_outer("d.items").alias("position", "item"))
    each = items.select("batch_id", "position", F.to_json("item").alias("value"))
    found = requests(each.select(F.xxhash64("batch_id", "position").alias("id"), "value", "batch_id", "position"), "batch_id", "position").drop("image_id")
    whole = Window.partitionBy("batch_id")
    n, total = F.count("position").over(whole), F.sum(F.octet_length("content").cast("bigint")).over(whole)
    wrong = F.max(F.when(F.col("position").isNull() | F.col("error_code").isNotNull(), 1).otherwise(0)).over(whole) == 1
    refused = wrong | ~n.between(1, most) | F.coalesce(total > most_bytes, F.lit(False))
    found = found.withColumn("batch_error_code", F.when(refused, "invalid_request"))
    return found.withColumn("content", F.when(F.col("batch_error_code").isNull(), F.col("content")))


def batch_results(done: DataFrame) -> DataFrame:
    """batch_id, results: the results (batch_id, position, result) of each batch in the order of its items."""
    each = F.array_sort(F.collect_list(F.struct("position", "result")))
    return done.groupBy("batch_id").agg(F.transform(each, lambda z: z["result"]).alias("results"))
