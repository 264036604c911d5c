"""The quality classifier: its statistics by hand, its algebra by brute force, and what it finds on rows held out."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, DATA, table

from rasterlines.llm import vectors
from rasterlines.llm.common import Scratch
from rasterlines.llm.quality_classifier import STATISTICS, QuadraticDiscriminant, classify, moments, op12_quality_classifier, oracle_weight, statistics, with_statistics


def by_hand(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    chars, n = sum(map(len, words)), len(words)
    odds = lambda part, whole: np.log((part + 0.5) / (max(whole - part, 0) + 0.5))
    count = lambda signs: odds(sum(text.count(bytes([c])) for c in signs), max(chars, sum(text.count(bytes([c])) for c in signs)))
    lines = [tuple(re.findall(rb"[^\x20\x09-\x0D]+", x)) for x in text.split(b"\n")]
    lines = [x for x in lines if x]
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    again = lambda xs: odds(len(xs) - len(Counter(xs)), len(xs))
    signs = [b"#*$%&<>", b"|", b"0123456789", bytes(range(65, 91)), b"!?", b".,;:"]
    return [np.log1p(n), np.log((chars + 5) / (n + 1)), *map(count, signs), odds(sum(len(w) <= 1 for w in words), n), odds(sum(len(w) > 20 for w in words), n),
            np.log((n + 1) / (len(lines) + 1)), again(lines), again(grams), odds(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), again(words)]


TEXTS = ["", " \n\t", "one", "a a a a a a", "The cat.\nThe  cat.\n\nA dog | 12 #!\nThe cat", "X" * 30 + " y", "Über été\nÜber été", "a b\nb a\na b c", *[t for _, t in AWKWARD if t]]


def test_statistics_by_hand():
    raw = [t.encode() for t in TEXTS]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    found = statistics(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert found.shape == (len(TEXTS), len(STATISTICS))
    assert np.allclose(found, [by_hand(t) for t in raw])
    assert vectors.column_bytes is not None and statistics(np.zeros(0, np.uint8), np.array([0])).shape == (0, len(STATISTICS))


def test_scores_are_log_density_differences(spark):
    rng, d = np.random.default_rng(2), len(STATISTICS)
    x = {0: rng.normal(0, 2, (80, d)), 1: rng.normal(1, 1, (300, d)) @ np.triu(rng.normal(0, 0.3, (d, d)) + np.eye(d))}
    rows = [(x[k][i].tolist(), k, 5) for k in x for i in range(len(x[k]))]
    sums = moments(spark.createDataFrame(rows, "statistics array<double>, quality int, sums int").repartition(7))
    for k in x:
        assert np.allclose(sums[k], np.concatenate([[len(x[k])], x[k].sum(0), (x[k].T @ x[k]).ravel()]))
    model = QuadraticDiscriminant(sums)
    pooled = sum(((x[k] - x[k].mean(0)).T @ (x[k] - x[k].mean(0))) for k in x) / 380
    scale = np.sqrt(np.diag(pooled))
    y = rng.normal(0, 2, (20, d))
    density = {}
    for k in x:
        w = d / (len(x[k]) + d)
        s = ((1 - w) * np.cov(x[k].T, bias=True) + w * pooled) / np.outer(scale, scale)
        v = oracle_weight(s, len(x[k]))
        assert 0 < v < 1
        s = (1 - v) * s + v * np.trace(s) / d * np.eye(d) + 1e-6 * np.eye(d)
        z = (y - x[k].mean(0)) / scale
        density[k] = -0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z)
    assert np.allclose(model.log_odds(y), density[1] - density[0] + np.log(300.5 / 80.5))
    assert ((model.score(y) >= 0.5) == (model.log_odds(y) >= 0)).all()


def test_awkward_documents(spark):
    docs = table(spark, AWKWARD)
    labels = spark.createDataFrame([(i, i % 2, None, "x") for i in range(12)] + [(4, 1, 0, "x"), (None, 1, 0, "x"), (3, None, 0, "x"), (5, 7, 1, "x")], "doc_id bigint, quality int, toxic int, text string")
    found = classify(docs, labels, Scratch(spark, "t")).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert len({r.score for r in found if r.doc_id == 6}) <= 2
    assert classify(table(spark, []), labels, Scratch(spark, "t")).collect() == []
    assert {r.score for r in classify(docs, labels.where("false"), Scratch(spark, "t")).collect()} == {0.5}
    assert {r.score for r in classify(docs, labels.where("quality = 1"), Scratch(spark, "t")).collect()} == {1.0}
    assert [c for c in with_statistics(docs).columns if c != "statistics"] == [c for c in docs.columns if c != "text"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_held_out_documents(spark):
    sf = str(DATA / "sf0.1")
    found = op12_quality_classifier(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in found.where("held_out").collect() if r.doc_id in labels]
    good, bad = ([p for y, p in held if y == k] for k in (1, 0))
    assert len(held) > 1000 and sum(good) >= 0.98 * len(good) and sum(bad) <= 0.02 * len(bad)
