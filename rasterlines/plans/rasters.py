"""Raster queries: each embedding is an 8 x 8 page of grey levels or probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import raster
from ..operators import pixels
from ..operators import regions as O
from .recognition import _P, scores

SIDE, TARGET = 8, 12


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, px, v: bytes 0 .. 255."""
    return scores(spark, sf_dir).select("vec_id", F.posexplode("p").alias("px", "p")).select("vec_id", "px", F.expr("cast(floor(least(greatest(p, cast(0 as float)), cast(1 as float)) * cast(255 as float)) as int)").alias("v"))


def alpha_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = levels(spark, sf_dir)
    return d.select("vec_id", "px", raster.on_white(F.col("v"), F.col("px") * 4).alias("v"))


def normalize_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = levels(spark, sf_dir)
    return d.select("vec_id", "px", *(raster.detector_value(F.col("v"), c).alias(f"c{c}") for c in range(3)))


def normalize_recognizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(spark, sf_dir).select("vec_id", "px", raster.recogniser_value(F.col("v")).alias("c"))


def bilinear_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taps of every target position for the sizes that parts have."""
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").cast("int").alias("size")).distinct()
    grid = sizes.select("size", F.explode(F.sequence(F.lit(0), F.lit(TARGET - 1))).alias("t"))
    position = (F.col("t") + 0.5) * (F.col("size").cast("double") / TARGET) - 0.5
    low = F.floor(position).cast("int")
    fraction = raster.single(position - low)
    edge = (position < 0) | (low >= F.col("size") - 1)
    return grid.select(
        "size",
        "t",
        F.when((position < 0) | (F.col("size") == 1), 0).when(low >= F.col("size") - 1, F.col("size") - 1).otherwise(low).alias("left"),
        F.when(edge, 2048).otherwise(F.rint(raster.single(raster.single(F.lit(1.0)) - fraction) * raster.single(F.lit(2048.0))).cast("int")).alias("w0"),
        F.when(edge, 0).otherwise(F.rint(fraction * raster.single(F.lit(2048.0))).cast("int")).alias("w1"),
    )


def resize_bilinear_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 levels resized to 12 x 12 in fixed point: each target value is the weighted sum of four source values."""
    values = levels(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("px", "v"))).alias("s")).select("vec_id", F.col("s.v").alias("s"))
    d = values.select("vec_id", "s", F.explode(F.sequence(F.lit(0), F.lit(TARGET * TARGET - 1))).alias("px"))
    x, y = raster.bilinear_tap(F.col("px") % TARGET, SIDE, TARGET), raster.bilinear_tap(F.floor(F.col("px") / TARGET), SIDE, TARGET)
    d = d.withColumns({f"x_{k}": v for k, v in x.items()} | {f"y_{k}": v for k, v in y.items()})
    pick = lambda dy, dx: F.get("s", F.least(F.col("y_left") + dy, F.lit(SIDE - 1)) * SIDE + F.least(F.col("x_left") + dx, F.lit(SIDE - 1))).cast("bigint")
    total = sum(pick(dy, dx) * F.col(f"y_w{dy}") * F.col(f"x_w{dx}") for dy in (0, 1) for dx in (0, 1))
    return d.select("vec_id", "px", F.shiftright(total + (1 << 21), 22).cast("int").alias("v"))


def component_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = scores(spark, sf_dir).select(F.col("vec_id").alias("image_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), "p")
    return O.components(maps, threshold=0.5)


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = component_table(spark, sf_dir)
    return c.select(F.col("image_id").alias("vec_id"), "component", F.size("pixels").cast("bigint").alias("n_pixels"), F.array_min("pixels").alias("first_pixel"), F.array_max("pixels").alias("last_pixel"))


def component_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = component_table(spark, sf_dir).select(F.col("image_id").alias("vec_id"), "component", F.expr(f"transform(pixels, q -> q % {SIDE})").alias("xs"), F.expr(f"transform(pixels, q -> q div {SIDE})").alias("ys"))
    c = c.select("vec_id", "component", *(f(F.col(a)).cast("int").alias(n) for n, f, a in (("min_x", F.array_min, "xs"), ("max_x", F.array_max, "xs"), ("min_y", F.array_min, "ys"), ("max_y", F.array_max, "ys"))))
    return c.where(F.least(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) >= 3)


def component_fast_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = component_boxes(spark, sf_dir)
    p = scores(spark, sf_dir)
    inner = F.expr(f"filter(p, (x, q) -> q % {SIDE} between min_x and max_x and q div {SIDE} between min_y and max_y)")
    d = boxes.join(p, "vec_id").withColumn("inner", inner)
    mean = F.expr("aggregate(inner, 0D, (a, x) -> a + cast(x as double)) / size(inner)")
    return d.select("vec_id", "component", F.size("inner").cast("bigint").alias("n"), F.round(mean, 6).alias("score"))


def component_min_area_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = O.rectangles(component_table(spark, sf_dir))
    return c.select(F.col("image_id").alias("vec_id"), "component", F.round(F.col("rectangle.area"), 6).alias("area"))


def regions_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From probability map to scored, grown, projected quads in corner order."""
    maps = scores(spark, sf_dir).select(F.col("vec_id").alias("image_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), "p")
    found = O.detect_regions(maps, threshold=0.45, box_threshold=0.5, page_width=F.lit(64), page_height=F.lit(64), scale_x=F.lit(0.125).cast("float"), scale_y=F.lit(0.125).cast("float"))
    return found.select(F.col("image_id").alias("vec_id"), "component", F.round(F.col("score").cast("double"), 5).alias("score"), G.double_area(F.col("points")).alias("double_area"))


def component_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary pixels of each component."""
    maps = scores(spark, sf_dir).select(F.col("vec_id").alias("image_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), "p")
    return O.contours(maps, threshold=0.5).select(F.col("image_id").alias("vec_id"), "component", F.explode("pixels").alias("px"))


def perspective_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quad of each grey page, cut out and turned if it is tall: size, and each pixel."""
    d = levels(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("px", "v"))).alias("s"))
    k = F.col("vec_id")
    x0, y0 = k % 3, k % 2
    x1, y1 = x0 + 3 + k % 2, y0 + 2 + F.floor(k / 2) % 5
    point = lambda x, y: F.struct(x.cast("float").alias("x"), y.cast("float").alias("y"))
    bytes_of = F.unhex(F.array_join(F.transform("s", lambda z: F.repeat(F.lpad(F.hex(z["v"]), 2, "0"), 3)), ""))
    pages = d.select(k.alias("image_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), bytes_of.alias("rgb"), F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))).alias("quads"))
    found = pixels.crops(pages).withColumn("each", F.expr("transform(sequence(0, width * height - 1), i -> cast(conv(hex(substring(rgb, 3 * i + 1, 1)), 16, 10) as int))"))
    return found.select(F.col("image_id").alias("vec_id"), "width", "height", F.posexplode("each").alias("px", "v"))


_LEVELS = f"p AS ({_P}), levels AS (SELECT vec_id, px::INTEGER AS px, floor(least(greatest(p[px + 1], 0::FLOAT), 1::FLOAT) * 255::FLOAT)::INTEGER AS v FROM p, range(0, 64) r(px))"
_TAP = """SELECT t, CASE WHEN pos < 0 THEN 0 WHEN low >= {n} - 1 THEN {n} - 1 ELSE low END AS l, CASE WHEN pos < 0 OR low >= {n} - 1 THEN 2048 ELSE round_even(((1::FLOAT - f)::FLOAT * 2048::FLOAT)::DOUBLE, 0)::INTEGER END AS w0, CASE WHEN pos < 0 OR low >= {n} - 1 THEN 0 ELSE round_even((f * 2048::FLOAT)::DOUBLE, 0)::INTEGER END AS w1
  FROM (SELECT t, pos, floor(pos)::INTEGER AS low, (pos - floor(pos)::INTEGER)::FLOAT AS f FROM (SELECT t, (t + 0.5::DOUBLE) * ({n}::DOUBLE / 12) - 0.5 AS pos FROM range(0, 12) r(t)))"""
_COMPONENTS = f"""p AS ({_P}), fg AS (SELECT vec_id, px::INTEGER AS px, px % 8 AS x, px // 8 AS y FROM p, range(0, 64) r(px) WHERE p[px + 1] > 0.5::FLOAT),
reach AS (SELECT vec_id, px, px AS root, x, y FROM fg UNION SELECT f.vec_id, f.px, r.root, f.x, f.y FROM reach r JOIN fg f ON f.vec_id = r.vec_id AND abs(f.x - r.x) <= 1 AND abs(f.y - r.y) <= 1),
roots AS (SELECT vec_id, px, min(root) AS root, any_value(x) AS x, any_value(y) AS y FROM reach GROUP BY vec_id, px),
comps AS (SELECT vec_id, px, x, y, (dense_rank() OVER (PARTITION BY vec_id ORDER BY root) - 1)::INTEGER AS component FROM roots)"""
_BOXES = f"""{_COMPONENTS}, boxes AS (SELECT vec_id, component, min(x)::INTEGER AS min_x, max(x)::INTEGER AS max_x, min(y)::INTEGER AS min_y, max(y)::INTEGER AS max_y FROM comps GROUP BY vec_id, component HAVING least(max(x) - min(x), max(y) - min(y)) >= 3)"""

QUERIES = {f.__name__: f for f in (alpha_composite, normalize_detector, normalize_recognizer, bilinear_coefficients, resize_bilinear_map, connected_components, component_boxes, component_fast_score, component_min_area_rect, regions_end_to_end, component_contours, perspective_crop)}


def _normal(channel: int) -> str:
    m, s = raster.DETECTOR_MEAN[channel], raster.DETECTOR_STD[channel]
    return f"((((v::FLOAT / 255::FLOAT)::FLOAT - {m}::FLOAT)::FLOAT) / {s}::FLOAT)::FLOAT AS c{channel}"


QUERIES_SQL = {
    "alpha_composite": f"WITH {_LEVELS} SELECT vec_id, px, (v * (px * 4) + 255 * (255 - px * 4) + 127) // 255 AS v FROM levels",
    "normalize_detector": f"WITH {_LEVELS} SELECT vec_id, px, {_normal(0)}, {_normal(1)}, {_normal(2)} FROM levels",
    "normalize_recognizer": f"WITH {_LEVELS} SELECT vec_id, px, ((v::FLOAT / 127.5::FLOAT)::FLOAT - 1::FLOAT)::FLOAT AS c FROM levels",
    "bilinear_coefficients": """WITH s AS (SELECT DISTINCT p_size::INTEGER AS size FROM part), g AS (SELECT size, t::INTEGER AS t, (t + 0.5::DOUBLE) * (size::DOUBLE / 12) - 0.5 AS pos FROM s, range(0, 12) r(t)), l AS (SELECT *, floor(pos)::INTEGER AS low FROM g), f AS (SELECT *, (pos - low)::FLOAT AS f, pos < 0 OR low >= size - 1 AS edge FROM l)
      SELECT size, t, CASE WHEN pos < 0 OR size = 1 THEN 0 WHEN low >= size - 1 THEN size - 1 ELSE low END AS "left", CASE WHEN edge THEN 2048 ELSE round_even(((1::FLOAT - f)::FLOAT * 2048::FLOAT)::DOUBLE, 0)::INTEGER END AS w0, CASE WHEN edge THEN 0 ELSE round_even((f * 2048::FLOAT)::DOUBLE, 0)::INTEGER END AS w1 FROM f""",
    "resize_bilinear_map": f"""WITH {_LEVELS}, tap AS ({_TAP.format(n=8)}), pix AS (SELECT vec_id, list(v ORDER BY px) AS s FROM levels GROUP BY vec_id)
      SELECT vec_id, (b.t * 12 + a.t)::INTEGER AS px, ((s[b.l * 8 + a.l + 1] * b.w0::BIGINT * a.w0 + s[b.l * 8 + least(a.l + 1, 7) + 1] * b.w0::BIGINT * a.w1 + s[least(b.l + 1, 7) * 8 + a.l + 1] * b.w1::BIGINT * a.w0 + s[least(b.l + 1, 7) * 8 + least(a.l + 1, 7) + 1] * b.w1::BIGINT * a.w1 + 2097152) >> 22)::INTEGER AS v
      FROM pix, tap a, tap b""",
    "connected_components": f"WITH RECURSIVE {_COMPONENTS} SELECT vec_id, component, count(*) AS n_pixels, min(px) AS first_pixel, max(px) AS last_pixel FROM comps GROUP BY vec_id, component",
    "component_boxes": f"WITH RECURSIVE {_BOXES} SELECT * FROM boxes",
    "component_fast_score": f"""WITH RECURSIVE {_BOXES}, v AS (SELECT vec_id, px % 8 AS x, px // 8 AS y, p[px + 1]::DOUBLE AS p FROM p, range(0, 64) r(px))
      SELECT b.vec_id, b.component, count(*) AS n, round(avg(v.p), 6) AS score FROM boxes b JOIN v ON v.vec_id = b.vec_id AND v.x BETWEEN min_x AND max_x AND v.y BETWEEN min_y AND max_y GROUP BY b.vec_id, b.component""",
    "component_min_area_rect": f"""WITH RECURSIVE {_COMPONENTS}, pairs AS (
        SELECT a.vec_id, a.component, a.x AS ax, a.y AS ay, (b.x - a.x)::DOUBLE AS ux, (b.y - a.y)::DOUBLE AS uy FROM comps a JOIN comps b USING (vec_id, component) WHERE a.px <> b.px),
      spans AS (
        SELECT q.vec_id, q.component, ax, ay, ux, uy, min(ux * (c.y - ay) - uy * (c.x - ax)) AS lo, max(ux * (c.y - ay) - uy * (c.x - ax)) AS hi, max(ux * c.x + uy * c.y) - min(ux * c.x + uy * c.y) AS along
        FROM pairs q JOIN comps c USING (vec_id, component) GROUP BY q.vec_id, q.component, ax, ay, ux, uy),
      rects AS (SELECT *, along / sqrt(ux * ux + uy * uy) AS side_a, hi / sqrt(ux * ux + uy * uy) AS side_b FROM spans WHERE lo >= 0 AND hi > 0)
      SELECT vec_id, component, round(min(side_a * side_b), 6) AS area FROM rects GROUP BY vec_id, component""",
    "component_contours": f"""WITH RECURSIVE {_COMPONENTS} SELECT c.vec_id, c.component, c.px FROM comps c
      WHERE (SELECT count(*) FROM fg f WHERE f.vec_id = c.vec_id AND abs(f.x - c.x) <= 1 AND abs(f.y - c.y) <= 1) < 9""",
    "perspective_crop": f"""WITH {_LEVELS}, q AS (SELECT DISTINCT vec_id, vec_id % 3 AS x0, vec_id % 2 AS y0, 3 + vec_id % 2 AS w, 2 + vec_id // 2 % 5 AS h FROM p),
      t AS (SELECT *, 2 * h >= 3 * w AS tall FROM q),
      o AS (SELECT vec_id, CASE WHEN tall THEN h ELSE w END AS width, CASE WHEN tall THEN w ELSE h END AS height, x, y, x0, y0, w, tall FROM t, range(0, 8) a(x), range(0, 8) b(y))
      SELECT o.vec_id, width::INTEGER AS width, height::INTEGER AS height, (y * width + x)::INTEGER AS px, v FROM o JOIN levels l ON l.vec_id = o.vec_id AND x < width AND y < height
        AND l.px = CASE WHEN tall THEN (y0 + x) * 8 + x0 + w - 1 - y ELSE (y0 + y) * 8 + x0 + x END""",
}
