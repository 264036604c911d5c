"""Region queries: a line item is a region of the page that its order is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import recognition as R
from ..schema import CHUNK, MAX_CROP_PIXELS

PAGE_WIDTH, PAGE_HEIGHT = 320, 240


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, i (line number), x, y, w, h, confidence, and points, a quad with its corners out of order."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    d = li.select(
        F.col("l_orderkey").alias("page_id"),
        F.col("l_linenumber").alias("i"),
        F.expr("cast(l_partkey % 200 as int)").alias("x"),
        F.expr("cast(l_suppkey % 40 as int)").alias("y"),
        F.expr("cast(l_quantity as int) + 20").alias("w"),
        F.expr("cast(l_partkey % 30 as int) + 8").alias("h"),
        F.expr("cast(1 - 5 * l_discount as float)").alias("confidence"),
        F.expr("cast(l_suppkey % 7 as int) - 3").alias("skew"),
    )
    corner = lambda dx, dy: F.struct((F.col("x") + dx).cast("float").alias("x"), (F.col("y") + dy).cast("float").alias("y"))
    return d.withColumn("points", F.array(corner(F.col("w"), F.col("h")), corner(F.lit(0), F.lit(0)), corner(F.lit(0), F.col("h")), corner(F.col("w"), F.greatest(F.col("skew"), F.lit(0)))))


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).withColumn("q", G.canonical_quad(F.col("points")))


def canonical_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _quads(spark, sf_dir)
    return d.select("page_id", "i", *(F.col("q")[k][c].alias(f"{c}{k}") for k in range(4) for c in ("x", "y")))


def polygon_shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _quads(spark, sf_dir)
    area = G.double_area(F.col("q"))
    return d.select("page_id", "i", area.alias("double_area"), (area > 0).alias("positive"))


def polygon_convexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _quads(spark, sf_dir)
    convex = G.strictly_convex(F.col("q")) & G.inside(F.col("q"), F.lit(PAGE_WIDTH), F.lit(PAGE_HEIGHT))
    d = d.withColumn("ok", convex).withColumn("page_ok", F.min("ok").over(Window.partitionBy("page_id")))
    return d.select("page_id", "i", "ok", F.when(~F.col("page_ok"), "invalid_image").alias("page_error"))


def crop_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    d = _quads(spark, sf_dir).select("page_id", "i", G.crop_width(q).alias("crop_width"), G.crop_height(q).alias("crop_height"))
    return d.withColumn("rotated", F.col("crop_height") * 2 >= F.col("crop_width") * 3)


def crop_pixel_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = crop_sizes(spark, sf_dir).withColumn("pixels", F.col("crop_width").cast("bigint") * F.col("crop_height") * 40000)
    w = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("running", F.sum("pixels").over(w))
    return d.groupBy("page_id").agg(F.sum("pixels").alias("pixels"), F.min(F.when(F.col("running") > MAX_CROP_PIXELS, F.col("i"))).alias("first_over")).withColumn("error", F.when(F.col("first_over").isNotNull(), "overloaded"))


def unclip_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = regions(spark, sf_dir).withColumns({"short": F.least("w", "h").cast("double"), "long": F.greatest("w", "h").cast("double")})
    d = d.withColumn("distance", G.unclip_distance(F.col("short"), F.col("long"))).withColumn("grown_short", F.col("short") + 2 * F.col("distance"))
    return d.where((F.col("short") >= 12) & (F.col("grown_short") >= 5)).select("page_id", "i", F.round("distance", 6).alias("distance"), F.round("grown_short", 6).alias("grown_short"), F.round(2 * (F.col("short") + F.col("long")), 6).alias("perimeter"))


def project_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = regions(spark, sf_dir).withColumn("scale", F.expr("cast(cast(0.5 as float) + cast(i as float) / cast(8 as float) as float)"))
    scale = F.col("scale").cast("double")
    return d.select("page_id", "i", G.project(F.col("x") - 1.5, scale, F.lit(PAGE_WIDTH)).alias("px"), G.project(F.col("y") - 1.5, scale, F.lit(PAGE_HEIGHT)).alias("py"))


def _ordered(d: DataFrame) -> DataFrame:
    pages = d.groupBy("page_id").agg(F.collect_list(F.struct("y", "x", "i", "confidence")).alias("items"))
    return pages.withColumn("ordered", G.reading_order("items"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(regions(spark, sf_dir)).select("page_id", F.posexplode("ordered").alias("rank", "item")).select("page_id", "rank", F.col("item.i").alias("i"), F.col("item.x").alias("x"), F.col("item.y").alias("y"))


def reading_order_filter_quirk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose order, once regions of low confidence are dropped, is no longer the order of those left."""
    d = _ordered(regions(spark, sf_dir)).withColumn("left", F.filter("ordered", lambda z: z["confidence"] >= F.lit(0.75).cast("float")))
    d = d.withColumn("again", G.reading_order("left"))
    return d.select("page_id", F.size("ordered").cast("bigint").alias("n"), F.size("left").cast("bigint").alias("n_left"), (F.col("left") != F.col("again")).alias("moved"))


def recognizer_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of eight regions of a sheet (eight pages), in order."""
    d = regions(spark, sf_dir).withColumn("sheet", F.expr("page_id div 8"))
    rank = F.row_number().over(Window.partitionBy("sheet").orderBy("page_id", "i", "x", "y", "w", "h")) - 1
    return d.select("sheet", "page_id", "i", "w", "h", rank.alias("rank")).withColumn("chunk", F.floor(F.col("rank") / CHUNK).cast("int"))


def aspect_sort_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = recognizer_chunks(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("sheet", "chunk").orderBy(F.col("w") / F.col("h"), "rank")) - 1
    return d.select("sheet", "chunk", "rank", place.alias("tensor_row"), "w", "h")


def recognizer_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = aspect_sort_restore(spark, sf_dir).withColumn("width", R.recogniser_width(F.col("w"), F.col("h")))
    widest = F.max("width").over(Window.partitionBy("sheet", "chunk"))
    return d.select("sheet", "chunk", "rank", "width", F.least(F.lit(3200), F.greatest(F.lit(320), widest)).alias("batch_width"))


_REGIONS = """regions AS (
  SELECT l_orderkey AS page_id, l_linenumber AS i, (l_partkey % 200)::INTEGER AS x, (l_suppkey % 40)::INTEGER AS y, l_quantity::INTEGER + 20 AS w, (l_partkey % 30)::INTEGER + 8 AS h,
    (1 - 5 * l_discount)::FLOAT AS confidence, (l_suppkey % 7)::INTEGER - 3 AS skew FROM lineitem)"""
_QUADS = f"""{_REGIONS}, quads AS (SELECT *, x::FLOAT AS x0, y::FLOAT AS y0, (x + w)::FLOAT AS x1, (y + greatest(skew, 0))::FLOAT AS y1, (x + w)::FLOAT AS x2, (y + h)::FLOAT AS y2, x::FLOAT AS x3, (y + h)::FLOAT AS y3 FROM regions)"""
_CROPS = f"""{_QUADS}, crops AS (SELECT page_id, i, floor(greatest(sqrt((w * w + (y1 - y0) * (y1 - y0))::DOUBLE), w::DOUBLE))::INTEGER AS crop_width, floor(greatest(h::DOUBLE, (y2 - y1)::DOUBLE))::INTEGER AS crop_height FROM quads)"""
_CHUNKS = f"""{_REGIONS}, ranks AS (SELECT *, page_id // 8 AS sheet, row_number() OVER (PARTITION BY page_id // 8 ORDER BY page_id, i, x, y, w, h) - 1 AS rank FROM regions), chunks AS (SELECT *, rank // 8 AS chunk FROM ranks)"""
_CROSS = " AND ".join(f"(x{(k + 1) % 4} - x{k}) * (y{(k + 2) % 4} - y{(k + 1) % 4}) - (y{(k + 1) % 4} - y{k}) * (x{(k + 2) % 4} - x{(k + 1) % 4}) > 0" for k in range(4))
_INSIDE = " AND ".join(f"x{k} BETWEEN 0 AND {PAGE_WIDTH - 1} AND y{k} BETWEEN 0 AND {PAGE_HEIGHT - 1}" for k in range(4))


def _order_sql(items: str) -> str:
    """Insertion of each item in (y, x, i) order, as a fold over singleton lists."""
    passed = "coalesce(list_max(list_transform(acc, lambda a, j: CASE WHEN abs(it[1].y - a.y) < 10 AND it[1].x < a.x THEN 0 ELSE j END)), 0)"
    return f"list_reduce(list_transform(list_sort({items}), lambda z: [z]), lambda acc, it: acc[1 : {passed}] || it || acc[{passed} + 1 :])"


_ORDERED = f"""{_REGIONS}, pages AS (SELECT page_id, list({{'y': y, 'x': x, 'i': i, 'c': confidence}}) AS items FROM regions GROUP BY page_id), ordered AS (SELECT page_id, {_order_sql('items')} AS o FROM pages)"""

QUERIES = {f.__name__: f for f in (canonical_quads, polygon_shoelace, polygon_convexity, crop_sizes, crop_pixel_budget, unclip_rect, project_regions, reading_order, reading_order_filter_quirk, recognizer_chunks, aspect_sort_restore, recognizer_widths)}

QUERIES_SQL = {
    "canonical_quads": f"WITH {_QUADS} SELECT page_id, i, x0, y0, x1, y1, x2, y2, x3, y3 FROM quads",
    "polygon_shoelace": f"WITH {_QUADS}, a AS (SELECT page_id, i, (((x0 * y1 - x1 * y0) + (x1 * y2 - x2 * y1)) + (x2 * y3 - x3 * y2)) + (x3 * y0 - x0 * y3) AS double_area FROM quads) SELECT *, double_area > 0 AS positive FROM a",
    "polygon_convexity": f"WITH {_QUADS}, c AS (SELECT page_id, i, {_CROSS} AND {_INSIDE} AS ok FROM quads) SELECT page_id, i, ok, CASE WHEN NOT bool_and(ok) OVER (PARTITION BY page_id) THEN 'invalid_image' END AS page_error FROM c",
    "crop_sizes": f"WITH {_CROPS} SELECT *, crop_height * 2 >= crop_width * 3 AS rotated FROM crops",
    "crop_pixel_budget": f"""WITH {_CROPS}, p AS (SELECT *, crop_width::BIGINT * crop_height * 40000 AS px FROM crops), r AS (SELECT *, sum(px) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS running FROM p)
      SELECT page_id, sum(px)::BIGINT AS pixels, min(i) FILTER (running > {MAX_CROP_PIXELS}) AS first_over, CASE WHEN min(i) FILTER (running > {MAX_CROP_PIXELS}) IS NOT NULL THEN 'overloaded' END AS error FROM r GROUP BY page_id""",
    "unclip_rect": f"""WITH {_REGIONS}, s AS (SELECT *, least(w, h)::DOUBLE AS short, greatest(w, h)::DOUBLE AS long FROM regions), d AS (SELECT *, short * long * 1.5 / (2 * (short + long)) AS distance FROM s)
      SELECT page_id, i, round(distance, 6) AS distance, round(short + 2 * distance, 6) AS grown_short, round(2 * (short + long), 6) AS perimeter FROM d WHERE short >= 12 AND short + 2 * distance >= 5""",
    "project_regions": f"""WITH {_REGIONS}, s AS (SELECT *, (0.5::FLOAT + (i::FLOAT / 8::FLOAT)::FLOAT)::FLOAT::DOUBLE AS scale FROM regions)
      SELECT page_id, i, least(greatest(round_even(((x - 1.5)::DOUBLE / scale)::DOUBLE, 0)::DOUBLE + 0.0, 0.0), {PAGE_WIDTH - 1})::DOUBLE AS px, least(greatest(round_even(((y - 1.5)::DOUBLE / scale)::DOUBLE, 0)::DOUBLE + 0.0, 0.0), {PAGE_HEIGHT - 1})::DOUBLE AS py FROM s""",
    "reading_order": f"WITH {_ORDERED} SELECT page_id, (unnest(range(1, len(o) + 1)) - 1)::INTEGER AS rank, unnest(o).i AS i, unnest(o).x AS x, unnest(o).y AS y FROM ordered",
    "reading_order_filter_quirk": f"""WITH {_ORDERED}, l AS (SELECT page_id, o, list_filter(o, lambda z: z.c >= 0.75::FLOAT) AS l FROM ordered)
      SELECT page_id, len(o) AS n, len(l) AS n_left, CASE WHEN len(l) = 0 THEN false ELSE l <> {_order_sql('l')} END AS moved FROM l""",
    "recognizer_chunks": f"WITH {_CHUNKS} SELECT sheet, page_id, i, w, h, rank::INTEGER AS rank, chunk::INTEGER AS chunk FROM chunks",
    "aspect_sort_restore": f"WITH {_CHUNKS} SELECT sheet, chunk::INTEGER AS chunk, rank::INTEGER AS rank, (row_number() OVER (PARTITION BY sheet, chunk ORDER BY w::DOUBLE / h, rank) - 1)::INTEGER AS tensor_row, w, h FROM chunks",
    "recognizer_widths": f"""WITH {_CHUNKS}, s AS (SELECT *, least(3200, greatest(1, (w * 48 + h - 1) // h))::INTEGER AS width FROM chunks)
      SELECT sheet, chunk::INTEGER AS chunk, rank::INTEGER AS rank, width, least(3200, greatest(320, max(width) OVER (PARTITION BY sheet, chunk)))::INTEGER AS batch_width FROM s""",
}
