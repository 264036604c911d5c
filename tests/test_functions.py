"""Column functions at the edges that the queries' tables do not reach."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from rasterlines.functions import admission as A
from rasterlines.functions import geometry as G
from rasterlines.functions import raster
from rasterlines.functions import recognition as R


def one(spark, column, **values):
    df = spark.range(1)
    for k, (kind, v) in values.items():
        df = df.withColumn(k, F.lit(v).cast(kind))
    return df.select(column).first()[0]


def ctc(spark, rows, symbols):
    classes = len(symbols) + 1
    p = [float(x) for r in rows for x in r]
    d = spark.createDataFrame([(p,)], "p array<float>").withColumn("rows", R.score_rows("p", classes)).withColumn("best", R.best_classes("rows")).withColumn("steps", R.emitted("best"))
    return tuple(d.select(R.ctc_text("steps", F.array(*map(F.lit, symbols))), R.ctc_confidence("steps")).first())


def hot(k, v, n=4):
    return [v if i == k else (1 - v) / (n - 1) if k else 0.0 for i in range(n)]


def test_ctc_repeats_blanks_and_ties(spark):
    rows = [[0, 0.9, 0, 0], [0, 0.8, 0, 0], [1, 0, 0, 0], [0, 0.7, 0, 0], [0, 0, 0, 0.6], [0, 0, 0.5, 0]]
    text, confidence = ctc(spark, rows, ["a", "b", " "])
    assert text == "aa b" and abs(confidence - 0.675) < 1e-6
    assert ctc(spark, [[0.1, 0.8, 0.8, 0]], ["a", "b", "c"])[0] == "a"
    assert ctc(spark, [], ["a", "b", "c"]) == ("", 0.0)
    assert ctc(spark, [[1, 0, 0, 0]], ["a", "b", "c"]) == ("", 0.0)


def test_detector_sides(spark):
    for side, want in {31: 32, 32: 32, 63: 64, 64: 64, 959: 960, 960: 960, 961: 960, 48: 64, 80: 64}.items():
        assert one(spark, raster.detector_side(F.lit(side), F.lit(side))) == want
    assert one(spark, raster.detector_side(F.lit(1), F.lit(16384))) == 32


def test_strict_base64(spark):
    good = base64.b64encode(b"ab").decode()
    assert one(spark, A.strict_base64(F.lit(good))) == b"ab"
    for bad in ("YWI", "YWJ=", "YW I=", "YWI=\n", "=YWI"):
        assert one(spark, A.strict_base64(F.lit(bad))) is None


def test_projection_rounds_half_to_even_without_negative_zero(spark):
    for x, want in {-1.5: 0, -0.5: 0, 0.5: 0, 1.5: 2, 2.5: 2, 3.5: 4, 99.0: 9}.items():
        got = one(spark, G.project(F.lit(x), F.lit(1.0), F.lit(10)))
        assert got == want and str(got)[0] != "-"


def test_unclip_distance(spark):
    assert abs(one(spark, G.unclip_distance(F.lit(4.0), F.lit(10.0))) - 60 / 28) < 1e-12


def test_canonical_quad_of_a_diamond(spark):
    p = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(1, 2), (0, 1), (2, 1), (1, 0)]))
    assert [tuple(q) for q in one(spark, G.canonical_quad(p))] == [(1, 0), (2, 1), (1, 2), (0, 1)]


def test_reading_order_keeps_strict_tolerance(spark):
    def order(points):
        d = spark.createDataFrame([([(float(y), float(x), i) for i, (x, y) in enumerate(points)],)], "items array<struct<y:float,x:float,i:int>>")
        return [points[r.i] for r in d.select(G.reading_order("items").alias("o")).first().o]

    assert order([(30, 0), (10, 5), (20, 9)]) == [(10, 5), (20, 9), (30, 0)]
    assert order([(30, 0), (10, 10)]) == [(30, 0), (10, 10)]


def test_sniffing_and_metadata(spark):
    assert one(spark, A.sniffed_format(F.lit(A.PNG_SIGNATURE))) == "png"
    assert one(spark, A.sniffed_format(F.lit(b"\xff\xd8\xff\xe1"))) == "jpeg"
    assert one(spark, A.sniffed_format(F.lit(b""))) is None
    assert one(spark, A.metadata_error(F.lit(1), F.lit(16384), F.lit(4096))) is None
    assert one(spark, A.metadata_error(F.lit(1), F.lit(16384), F.lit(4097))) == "invalid_request"
    assert one(spark, A.metadata_error(F.lit(0), F.lit(1), F.lit(1))) == "invalid_request"
    assert one(spark, A.metadata_error(F.lit(None).cast("long"), F.lit(1), F.lit(1))) == "invalid_request"


def test_urls_and_names(spark):
    for url, ok in {"https://huggingface.co/a": True, "http://huggingface.co/a": False, "https://u@huggingface.co/a": False, "https://huggingface.co:443/a": False, "https://evil.co/huggingface.co": False}.items():
        assert one(spark, A.allowed_url(F.lit(url))) is ok
    for name, ok in {"a.b-c_1": True, ".": False, "..": False, "a\n": False, "x" * 129: False}.items():
        assert one(spark, A.safe_identifier(F.lit(name))) is ok
