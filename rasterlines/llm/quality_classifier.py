"""Document quality by regularised quadratic discriminant analysis.

One pass over the whole texts gives statistics of each document (shares of
symbols, digits, capitals and stops, repeated lines and words, variety, lengths);
shares are taken to logarithms of odds, counts to logarithms.  Each class is a
normal distribution over them, with a covariance shrunk twice: towards that of
both classes together, the more the fewer rows its class has, and then towards
a multiple of the identity (in units of the pooled deviations) at the oracle
approximating weight, which sizes and traces give.  The Cholesky factor of each
class is made once and sent with the scoring tasks: a document's score comes from
the difference of its two Mahalanobis log-densities and the log-odds of the
classes.  The difference is divided by the number of statistics, as they are no
independent witnesses; that changes no verdict.

Means and covariances are sums over all learning rows, none sampled: a row a
class and task, which Spark adds up.  Learnt are rows whose crc32(doc_id as text)
mod ``folds`` is not ``fold``.

Nulls: a null text counts as empty, a null label as none; a null doc_id is scored
and held out.  Empty texts have statistics of their own and get a score.  Repeated
rows score alike and are learnt from as often as they are there; of several labels
of a doc_id the largest counts.  Other columns are ignored by the query.  Texts of any length are used whole.
Without two rows of each class the score is the share of label 1 among the
learning rows, one half without any.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .common import Scratch


def _bytes(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_CAPITALS = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_CLASSES = (b"#*$%&<>", b"|", _DIGITS, _CAPITALS, b"!?", b".,;:")
STATISTICS = ["words", "word_length", "marks", "bars", "digits", "capitals", "shouts", "stops", "short_words", "long_words", "words_a_line", "repeated_lines", "repeated_trigrams", "echoed_words", "distinct_words"]


def _odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _repeats(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many keys of each document are equal to an earlier one of it."""
    if not len(keys):
        return np.zeros(n)
    _, first = np.unique(vectors.mix(keys + vectors.mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n).astype(float)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text."""
    n = len(offsets) - 1
    starts, ends = vectors.word_spans(raw, offsets, vectors.BETWEEN_SPACES)
    bounds = vectors.counts_in(starts, offsets)
    words = np.diff(bounds)
    length = ends - starts
    doc = np.repeat(np.arange(n), words)
    chars = np.bincount(doc, length, minlength=n)
    counted = [np.diff(np.concatenate([[0], np.cumsum(_bytes(c)[raw])])[offsets]) for c in _CLASSES]
    hashes = vectors.span_hashes(raw, starts, ends)
    # Lines with a word: the words between line feeds, hashed as runs.
    feeds = np.flatnonzero(raw == 10)
    line = np.searchsorted(feeds, starts) + doc  # a text's end ends a line, too
    new = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        place = np.arange(len(line)) - np.repeat(new, np.diff(np.append(new, len(line))))
        lines = np.add.reduceat(vectors.mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), new) if len(new) else np.zeros(0, np.uint64)
        grams, at = vectors.grams(hashes, bounds, 3)
        n_lines, n_grams = np.bincount(doc[new], minlength=n), np.diff(at)
        same_lines = _repeats(lines, doc[new], n)
        same_grams = _repeats(grams, np.repeat(np.arange(n), n_grams), n)
        same_words = _repeats(hashes, doc, n)
    echo = np.flatnonzero((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))
    out = [
        np.log1p(words),
        np.log((chars + 5) / (words + 1)),
        *(_odds(c, np.maximum(chars, c)) for c in counted),
        _odds(np.bincount(doc[length <= 1], minlength=n), words),
        _odds(np.bincount(doc[length > 20], minlength=n), words),
        np.log((words + 1) / (n_lines + 1)),
        _odds(same_lines, n_lines),
        _odds(same_grams, n_grams),
        _odds(np.bincount(doc[echo], minlength=n), words),
        _odds(same_words, words),
    ]
    return np.column_stack(out)


def with_statistics(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and ``statistics`` in place of ``text``."""
    at = docs.columns.index("text")

    def apply(batches):
        vectors.release()
        for batch in batches:
            raw, offsets = vectors.column_bytes(batch.column(at))
            found = [statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in vectors.slices(offsets)]
            x = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel()))
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, lists], [*(c for c in batch.schema.names if c != "text"), "statistics"])

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    return docs.mapInArrow(apply, StructType([f for f in docs.schema.fields if f.name != "text"]).add("statistics", ArrayType(DoubleType())))


def held_out(doc_id, folds: int = 3, fold: int = 1):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(True))


def moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each class its sums of 1, x and x x', as one vector; ``rows`` has statistics and quality (0 or 1)."""
    d = len(STATISTICS)

    def apply(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column(1).to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["quality", "sums"])

    parts = rows.select("statistics", F.col("quality").cast("int")).mapInArrow(apply, "quality int, sums array<double>")
    sums = parts.select("quality", F.posexplode("sums").alias("at", "x")).groupBy("quality", "at").agg(F.sum("x").alias("x"))
    out = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for r in sums.collect():  # 2 * (1 + d + d * d) numbers
        out[r.quality][r["at"]] = r.x
    return out


def oracle_weight(s: np.ndarray, n: float) -> float:
    """Oracle approximating shrinkage: the weight of the identity for a covariance of n rows."""
    p = len(s)
    square, trace = float((s * s).sum()), float(np.trace(s))
    above, below = (1 - 2 / p) * square + trace**2, (n + 1 - 2 / p) * (square - trace**2 / p)
    return 1.0 if below <= 0 else min(1.0, above / below)


class QuadraticDiscriminant:
    """Two normal distributions by their means and inverse Cholesky factors; ``log_odds`` of label 1."""

    def __init__(self, sums: dict[int, np.ndarray]):
        d = len(STATISTICS)
        n = {k: v[0] for k, v in sums.items()}
        self.factors = None
        self.prior = math.log((n[1] + 0.5) / (n[0] + 0.5))
        if min(n.values()) < 2:
            # Nothing to tell the classes by; the share of label 1 itself.
            self.share = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
            return
        mean = {k: v[1 : 1 + d] / n[k] for k, v in sums.items()}
        spread = {k: v[1 + d :].reshape(d, d) - n[k] * np.outer(mean[k], mean[k]) for k, v in sums.items()}
        pooled = (spread[0] + spread[1]) / (n[0] + n[1])
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        unit = np.outer(self.scale, self.scale)
        self.means, self.factors, self.offsets = {}, {}, {}
        for k in (0, 1):
            few = d / (n[k] + d)
            s = (1 - few) * spread[k] / n[k] / unit + few * pooled / unit
            w = oracle_weight(s, n[k])
            s = (1 - w) * s + w * np.trace(s) / d * np.eye(d) + 1e-6 * np.eye(d)
            lower = np.linalg.cholesky(s)
            self.means[k] = mean[k] / self.scale
            self.factors[k] = np.linalg.inv(lower)
            self.offsets[k] = -float(np.log(np.diag(lower)).sum())

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        def density(k):
            z = (x / self.scale - self.means[k]) @ self.factors[k].T
            return self.offsets[k] - 0.5 * (z * z).sum(1)

        return density(1) - density(0) + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / len(STATISTICS), -500, 500)))


def learn(known: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> QuadraticDiscriminant:
    """``known`` has doc_id and statistics."""
    told = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id", folds, fold)).groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.max("quality").alias("quality"))
    return QuadraticDiscriminant(moments(known.select("doc_id", "statistics").join(told, F.col("doc_id") == F.col("_id"))))


def scored(known: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    """doc_id and score of each row of ``known``."""

    def apply(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return known.select("doc_id", "statistics").mapInArrow(apply, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    known = scratch.keep(with_statistics(docs.select(F.col("doc_id").cast("bigint"), "text")), "statistics")
    found = scored(known, learn(known, labels, folds, fold))
    return found.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "quality"))
