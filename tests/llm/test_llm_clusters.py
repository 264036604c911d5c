"""Annulus clustering against a plain search over all centroids, and against its SQL."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest
from helpers import DATA

from rasterlines.llm.annulus_clusters import OP13_SQL, Annulus, cluster, op13_annulus_clusters
from rasterlines.llm.common import Scratch

SCHEMA = "vec_id bigint, embedding array<float>, cluster int, v string, distance string, n int"


def plain(vectors, k, rounds):
    """{vec_id: (cluster, distance)} and centroids, with Python's integers."""
    order = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in vectors)
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members: dict = {}
        for _, v in vectors:
            members.setdefault(nearest(v)[1], []).append(v)
        for n, own in members.items():
            centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, *reversed(nearest(v))) for i, v in vectors], centroids


def test_against_a_plain_search(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3, (9, 4)) * np.arange(1, 10)[:, None]
    rows = [(i, [float(x) for x in np.float32(centres[rng.integers(9)] + rng.normal(0, 1, 4))]) for i in range(600)]
    rows += [(600 + i, [0.25, -0.25, 0.5, 1.0]) for i in range(300)] + [(5, rows[5][1]), (None, [1.0, 1.0, 1.0, 1.0])]
    bad = [(901, None), (902, []), (903, [1.0, 2.0, 3.0]), (904, [1.0, 2.0, 3.0, None]), (905, [math.nan, 0.0, 0.0, 0.0]), (906, [math.inf, 0.0, 0.0, 0.0]), (907, [1.0] * 5)]
    table = spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in rows + bad], SCHEMA).repartition(5)
    want, centroids = plain([(i, [math.floor(64 * x) for x in v]) for i, v in rows], 7, 3)
    found, got = cluster(table, Scratch(spark, "t"), k=7, rounds=3, dim=4)
    assert got.tolist() == centroids
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_ties_go_to_the_smaller_number_and_few_are_compared():
    c = np.array([[30, 0], [0, 10], [10, 0], [-10, 0], [0, -30], [300, 0], [0, 500]], np.int64)
    search = Annulus(c)
    number, distance = search.nearest(np.array([[0, 0], [20, 0], [-20, 0], [299, 1]], np.int64))
    assert number.tolist() == [1, 0, 3, 5] and distance.tolist() == [100, 100, 100, 2]
    search.compared = 0
    search.nearest(np.tile(np.array([[0, 499]], np.int64), (100, 1)))
    assert search.compared == 100 * (2 + 1)


def test_no_centroid_is_missed_at_the_boundary():
    rng = np.random.default_rng(8)
    for scale in (3, 1000, 1 << 27):
        c = rng.integers(-scale, scale, (40, 3), endpoint=True)
        v = np.concatenate([rng.integers(-scale, scale, (500, 3), endpoint=True), c, -c])
        number, distance = Annulus(c).nearest(v)
        all_ = ((v[:, None, :] - c[None]) ** 2).sum(2)
        assert (number == all_.argmin(1)).all() and (distance == all_.min(1)).all()


def test_few_vectors_none_and_large_components(spark):
    none, c = cluster(spark.createDataFrame([], SCHEMA), Scratch(spark, "t"))
    assert none.collect() == [] and len(c) == 0
    two = spark.createDataFrame([(1, [1e30, -1e30], 0, "", "", 0), (2, [0.0, 0.0], 0, "", "", 0)], SCHEMA)
    found, c = cluster(two, Scratch(spark, "t"), dim=2)
    assert len(c) == 2 and {r.distance for r in found.collect()} == {0} and sorted(c.tolist()) == [[0, 0], [1 << 27, -(1 << 27)]]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{DATA}/sf0.01/embeddings.parquet'")
    df = op13_annulus_clusters(spark, str(DATA / "sf0.01"))
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.sql(OP13_SQL).select(", ".join(df.columns)).fetchall()))
