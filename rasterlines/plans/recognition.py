"""Decoding queries over 8 steps of 8 classes, taken from the 64 values of each embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import recognition as R

CLASSES = 8
SYMBOLS = ["a", "b", "c", "d", "e", "f", " "]
MINIMUM = 0.5


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and p: the values moved into [0, 1] in single precision."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.expr("transform(embedding, x -> cast(cast(x + cast(0.6 as float) as float) / cast(1.2 as float) as float))").alias("p"))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scores(spark, sf_dir).withColumn("rows", R.score_rows("p", CLASSES)).withColumn("best", R.best_classes("rows")).withColumn("steps", R.emitted("best"))
    symbols = F.array(*map(F.lit, SYMBOLS))
    return d.select("vec_id", R.ctc_text("steps", symbols).alias("text"), R.ctc_confidence("steps").alias("confidence"))


def ctc_greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir).where((F.col("text") != "") & (F.col("confidence") >= F.lit(MINIMUM).cast("float")))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scores(spark, sf_dir).select("vec_id", F.posexplode(R.best_classes(f"transform(sequence(0, {CLASSES - 1}), t -> slice(p, t * {CLASSES} + 1, {CLASSES}))")).alias("step", "best"))
    return d.select("vec_id", "step", F.col("best.k").alias("class"), F.col("best.v").alias("probability"))


def ctc_argmax_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir)


def ctc_collapse_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("vec_id").orderBy("step")
    d = steps(spark, sf_dir).withColumn("before", F.lag("class").over(w))
    kept = d.where((F.col("class") != 0) & (F.col("before").isNull() | (F.col("before") != F.col("class"))))
    return kept.groupBy("vec_id").agg(F.count("*").alias("n_emitted"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


def probability_rows_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scores(spark, sf_dir).withColumn("rows", R.score_rows("p", CLASSES))
    return d.select("vec_id", R.rows_normalised("rows", 3.0).alias("within_3"), R.rows_normalised("rows", 0.01).alias("normalised"))


def probability_map_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    d = e.select("vec_id", "embedding").join(scores(spark, sf_dir), "vec_id")
    return d.select("vec_id", R.probabilities_admitted("embedding", 64).alias("raw_admitted"), R.probabilities_admitted("p", 64).alias("moved_admitted"), R.probabilities_admitted("p", 63).alias("wrong_length"))


def foreground_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scores(spark, sf_dir)
    return d.select("vec_id", F.expr("cast(size(filter(p, x -> x > cast(0.5 as float))) as bigint)").alias("n_foreground"), F.expr("transform(p, x -> x > cast(0.5 as float))[0]").alias("first_pixel"))


def confidence_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("at", "c"))
    ok = ~F.isnan("c") & F.col("c").between(0, 1)
    return e.groupBy("vec_id").agg(F.count_if(ok).alias("admitted"), F.count_if(~ok).alias("rejected"))


_P = "SELECT vec_id, list_transform(embedding, lambda x: ((x + 0.6::FLOAT)::FLOAT / 1.2::FLOAT)::FLOAT) AS p FROM embeddings"
_STEPS = f"""p AS ({_P}), steps AS (
  SELECT vec_id, step, list_position(r, list_max(r)) - 1 AS class, list_max(r) AS probability
  FROM (SELECT vec_id, t::INTEGER AS step, p[t * 8 + 1 : t * 8 + 8] AS r FROM p, range(0, 8) s(t)))"""
_DECODED = f"""p AS ({_P}),
r AS (SELECT vec_id, list_transform(range(0, 8), lambda t: p[t * 8 + 1 : t * 8 + 8]) AS r FROM p),
m AS (SELECT vec_id, list_transform(r, lambda x: {{'k': list_position(x, list_max(x)) - 1, 'v': list_max(x)}}) AS m FROM r),
e AS (SELECT vec_id, list_filter(m, lambda z, j: z.k <> 0 AND (j = 1 OR m[greatest(j - 1, 1)].k <> z.k)) AS e FROM m),
decoded AS (
  SELECT vec_id, coalesce(array_to_string(list_transform(e, lambda z: (['a', 'b', 'c', 'd', 'e', 'f', ' '])[z.k]), ''), '') AS text,
    CASE WHEN len(e) = 0 THEN 0::FLOAT ELSE (list_reduce(list_transform(e, lambda z: z.v), lambda a, b: (a + b)::FLOAT, 0::FLOAT) / len(e)::FLOAT)::FLOAT END AS confidence FROM e)"""

QUERIES = {
    "ctc_greedy_decode": ctc_greedy_decode,
    "ctc_argmax_steps": ctc_argmax_steps,
    "ctc_collapse_lag": ctc_collapse_lag,
    "probability_rows_normalized": probability_rows_normalized,
    "probability_map_admission": probability_map_admission,
    "foreground_threshold": foreground_threshold,
    "confidence_admission": confidence_admission,
}

QUERIES_SQL = {
    "ctc_greedy_decode": f"WITH {_DECODED} SELECT * FROM decoded WHERE text <> '' AND confidence >= 0.5::FLOAT",
    "ctc_argmax_steps": f"WITH {_STEPS} SELECT vec_id, step, class::INTEGER AS class, probability FROM steps",
    "ctc_collapse_lag": f"""WITH {_STEPS}, l AS (SELECT *, lag(class) OVER (PARTITION BY vec_id ORDER BY step) AS before FROM steps)
      SELECT vec_id, count(*) AS n_emitted, min(step) AS first_step, max(step) AS last_step FROM l WHERE class <> 0 AND (before IS NULL OR before <> class) GROUP BY vec_id""",
    "probability_rows_normalized": f"""WITH p AS ({_P}), s AS (SELECT vec_id, list_reduce(p[t * 8 + 1 : t * 8 + 8], lambda a, b: (a + b)::FLOAT, 0::FLOAT) AS s FROM p, range(0, 8) r(t))
      SELECT vec_id, bool_and(abs(s - 1) <= 3.0) AS within_3, bool_and(abs(s - 1) <= 0.01) AS normalised FROM s GROUP BY vec_id""",
    "probability_map_admission": f"""WITH p AS ({_P}) SELECT vec_id, list_min(embedding) >= 0 AND list_max(embedding) <= 1 AS raw_admitted, list_min(p) >= 0 AND list_max(p) <= 1 AND len(p) = 64 AS moved_admitted, len(p) = 63 AS wrong_length
      FROM embeddings JOIN p USING (vec_id)""",
    "foreground_threshold": f"WITH p AS ({_P}) SELECT vec_id, len(list_filter(p, lambda x: x > 0.5::FLOAT)) AS n_foreground, p[1] > 0.5::FLOAT AS first_pixel FROM p",
    "confidence_admission": """SELECT vec_id, count(*) FILTER (c >= 0 AND c <= 1) AS admitted, count(*) FILTER (NOT (c >= 0 AND c <= 1)) AS rejected
      FROM (SELECT vec_id, unnest(embedding) AS c FROM embeddings) GROUP BY vec_id""",
}
