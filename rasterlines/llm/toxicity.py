"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled texts, one on what toxic
texts say more often than others, one on ordinary text.  A window - one word,
lower-cased and right-aligned in a frame of fixed width - is compressed with
each; the saving is the bytes that the toxic dictionary spares.  Stems that the
toxic dictionary knows spare bytes in words never seen, too.  A
document's savings (largest three, counts above several thresholds by length)
give its score through a logistic function.

Windows are single words because a match costs zstandard about as much as five
letters: in windows of eight words, one known word changes the length less
than the words around it do.  Dictionaries trained on whole texts, without
that comparison of the labels, find 41 of 97 toxic documents at best (README).

The logistic function is calibrated on rows that its dictionaries have not
seen: the learning rows are dealt into ``PARTS``, each part is measured with
dictionaries of the others, and all are fitted together.  The dictionaries
that score are those of all learning rows.

Labels are learnt only from rows whose crc32(doc_id as text) mod ``folds`` is
not 0, and of these at most ``per_class`` of each label (by hash of doc_id); in
the calibration each stands for as many labelled rows as it was drawn from, so
the prior is that of all of them.  A
dictionary word has to stand after at least four different words, so
that copies of one text do not count again.

Nulls: a null text counts as empty, a null label as none.  Empty texts get a
score from the same function.  A null doc_id is scored, and in fold 0 (held
out).  Repeated rows score alike; of several rows of a doc_id the smallest text
is learnt from, and of several labels the largest counts.  Other columns are
ignored.  Without enough toxic and ordinary rows to train and calibrate every
score is 0.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .common import Scratch
from .decontamination import text_words

#: Learning rows of each label at most.
PER_CLASS = 5000
FRAME = 32
#: Parts of the learning rows for the calibration.
PARTS = 3
#: The most frequent words to train a dictionary on; more would not fit into its bytes.
TOXIC_WORDS, ORDINARY_WORDS = 4000, 60000
_TOXIC_BYTES, _ORDINARY_BYTES = 16384, 112640
_SAVINGS = (2, 3, 4, 5)
_WIDTH = 3 + len(_SAVINGS) + 2 + 1


def held_out(doc_id, folds: int = 5):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def learning_rows(docs: DataFrame, labels: DataFrame, per_class: int, folds: int) -> DataFrame:
    """text, toxic, weight, part of a bounded sample of the labelled rows to learn from, one row a doc_id; weight is 1 / the label's sampling rate."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id", folds)).groupBy(F.col("doc_id").cast("bigint").alias("known_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("known_id")
    drawn = [known.where(f"toxic = {y}").orderBy(order).limit(per_class) for y in (1, 0)]
    chosen = drawn[0].union(drawn[1])
    rates = {r.toxic: max(1.0, r["count"] / per_class) for r in known.groupBy("toxic").count().collect()}
    weight = F.when(F.col("toxic") == 1, rates.get(1, 1.0)).otherwise(rates.get(0, 1.0))
    part = F.pmod(F.xxhash64("known_id", F.lit("part")), F.lit(PARTS)).cast("int")
    # At most 2 * per_class rows of 12 bytes.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id").cast("bigint") == F.col("known_id"))
    return found.groupBy("known_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", weight.alias("weight"), part.alias("part"))


def word_contexts(rows: DataFrame) -> DataFrame:
    """word, part, and after how many different words it stands in toxic (t) and ordinary (o) rows."""

    def pairs(batches):
        vectors.release()
        for batch in batches:
            raw, offsets = vectors.column_bytes(batch.column(0))
            for i, j in vectors.slices(offsets):
                low, starts, ends, words, bounds = text_words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                left = np.concatenate([np.zeros(1, np.uint64), words[:-1]]) if len(words) else words
                left[bounds[:-1][bounds[:-1] < len(words)]] = 0
                row = np.repeat(np.arange(i, j), np.diff(bounds))
                whole = low.tobytes()
                label = (batch.column(1).to_numpy()[row] * PARTS + batch.column(2).to_numpy()[row]).astype(np.int32)
                # Each word once for the word before it, the label and the part.
                _, at = np.unique(vectors.mix(words + vectors.mix(left) * np.uint64(3) + label.astype(np.uint64)), return_index=True)
                found = [whole[p:q] for p, q in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(left[at].view(np.int64)), pa.array(label[at] // PARTS), pa.array(label[at] % PARTS)], ["word", "before", "toxic", "part"])

    found = rows.select("text", "toxic", "part").mapInArrow(pairs, "word binary, before bigint, toxic int, part int").distinct()
    return found.groupBy("word", "part").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))


def dictionaries_of(contexts: DataFrame, n_toxic: int, n_ordinary: int) -> tuple[bytes, bytes] | None:
    """The toxic and the ordinary dictionary of some parts; None where one has nothing to be trained on."""
    if not n_toxic or not n_ordinary:
        return None
    words = contexts.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    enough, ratio = max(4, n_toxic // 250), 20 * n_toxic / n_ordinary
    excess = F.col("t") >= F.greatest(F.lit(float(enough)), (F.col("o") + 1) * ratio)
    rarer = F.col("t") >= F.greatest(F.lit(2.0), (F.col("o") + 1) * ratio / 20)
    spoken = [bytes(r.word) for r in words.where(excess).orderBy(F.desc("t"), "word").limit(TOXIC_WORDS).collect()]
    spoken = spoken or [bytes(r.word) for r in words.where(rarer).orderBy(F.desc("t"), "word").limit(20).collect()]
    usual = [bytes(r.word) for r in words.where(~excess & (F.col("o") > 0)).orderBy(F.desc("o"), "word").limit(ORDINARY_WORDS).collect()]
    if not spoken or not usual:
        return None
    return train_dictionary(spoken, _TOXIC_BYTES), train_dictionary(usual, _ORDINARY_BYTES)


def train_dictionary(words: list[bytes], size: int) -> bytes:
    frames = [w.rjust(FRAME) for w in words]
    frames = frames * (1 + 20000 // len(frames))
    return zstandard.train_dictionary(size, frames[:60000], k=16, d=8, level=19).as_bytes()


class Savings:
    """Bytes that the toxic dictionary spares for each word, remembered by hash."""

    def __init__(self, dictionaries: tuple[bytes, bytes], capacity: int = 1 << 19):
        self.compressors = []
        for d in dictionaries:
            d = zstandard.ZstdCompressionDict(d)
            d.precompute_compress(level=19)
            self.compressors.append(zstandard.ZstdCompressor(level=19, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.index = vectors.HashIndex(capacity)
        self._clear()

    def _clear(self) -> None:
        self.values = np.zeros(0, np.int16)

    def measure(self, words: list[bytes]) -> np.ndarray:
        frames = [w.rjust(FRAME) for w in words]
        if not frames:
            return np.zeros(0, np.int16)
        toxic, ordinary = (np.fromiter((len(x) for x in c.multi_compress_to_buffer(frames, threads=1)), np.int32, len(frames)) for c in self.compressors)
        return np.clip(ordinary - toxic, -100, 100).astype(np.int16)

    def features(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row of _WIDTH numbers a text; a word counts once for the largest savings and first counts."""
        low, starts, ends, words, bounds = text_words(raw, offsets)
        whole = low.tobytes()

        def new(at):
            self.values = np.concatenate([self.values, self.measure([whole[a:b] for a, b in zip(starts[at], ends[at], strict=True)])])

        number = vectors.numbered(self.index, words, new, self._clear)
        saved = self.values[number].astype(np.int64) if len(words) else np.zeros(0, np.int64)
        n = np.diff(bounds)
        doc = np.repeat(np.arange(len(n)), n)
        out = np.zeros((len(n), _WIDTH))
        scale = np.sqrt(n + 10.0)
        hot = np.flatnonzero(saved >= 1)  # savings below 1 add nothing to any feature
        once = np.unique(np.stack([doc[hot], -saved[hot], number[hot].astype(np.int64)]), axis=1) if len(hot) else np.zeros((3, 0), np.int64)
        first = np.searchsorted(once[0], np.arange(len(n)))
        for k in range(3):
            at = first + k
            good = (at < once.shape[1]) & (once[0][np.minimum(at, max(once.shape[1] - 1, 0))] == np.arange(len(n))) if once.shape[1] else np.zeros(len(n), bool)
            out[good, k] = -once[1][at[good]]
        for k, s in enumerate(_SAVINGS):
            out[:, 3 + k] = np.bincount(once[0][-once[1] >= s], minlength=len(n)) / scale
        for k, s in enumerate((3, 4)):
            out[:, 3 + len(_SAVINGS) + k] = np.bincount(doc[saved >= s], minlength=len(n)) / scale
        out[:, -1] = np.log1p(n)
        return out


def _savings(dictionaries: tuple[bytes, bytes]) -> Savings:
    return vectors.held(("savings", dictionaries), lambda: Savings(dictionaries))


def fit_logistic(x: np.ndarray, y: np.ndarray, count: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept, by Newton's method on scaled columns; a row stands for ``count`` rows."""
    mean = np.average(x, 0, count)
    scale = np.sqrt(np.average((x - mean) ** 2, 0, count)) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (count * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (count * (y - p)) - ridge * w)
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


class ToxicityModel:
    """Dictionaries and calibration; ``score`` applies them to the texts of a table."""

    def __init__(self, dictionaries: tuple[bytes, bytes] | None, weights: np.ndarray, intercept: float):
        self.dictionaries, self.weights, self.intercept = dictionaries, weights, intercept

    @classmethod
    def learn(cls, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = 5) -> ToxicityModel:
        scratch = Scratch(docs.sparkSession, "toxicity")
        rows = scratch.keep(learning_rows(docs, labels, per_class, folds), "rows")
        contexts = scratch.keep(word_contexts(rows), "contexts")
        counts = {(r.toxic, r.part): r["count"] for r in rows.groupBy("toxic", "part").count().collect()}

        def trained(without: int | None) -> tuple[bytes, bytes] | None:
            n = [sum(c for (y, part), c in counts.items() if y == label and part != without) for label in (1, 0)]
            return dictionaries_of(contexts if without is None else contexts.where(F.col("part") != without), *n)

        dictionaries, others = trained(None), {k: d for k in range(PARTS) if (d := trained(k))}
        scratch.drop("contexts")

        def measure(batches):
            for batch in batches:
                raw, offsets = vectors.column_bytes(batch.column(0))
                part = batch.column(3).to_numpy()
                x = np.zeros((batch.num_rows, _WIDTH))
                for k, d in others.items():
                    for i in np.flatnonzero(part == k):
                        x[i] = _savings(d).features(raw[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i])[0]
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "weight", "x"])

        # At most 2 * per_class rows of a few numbers.
        seen = rows.where(F.col("part").isin(list(others))).mapInArrow(measure, "toxic int, weight double, x array<double>").collect() if others else []
        scratch.drop()
        if not dictionaries or len({r.toxic for r in seen}) < 2:
            return cls(None, np.zeros(_WIDTH), -np.inf)
        order = sorted((r.x, r.toxic, r.weight) for r in seen)
        weights, intercept = fit_logistic(np.array([x for x, _, _ in order]), np.array([y for _, y, _ in order], float), np.array([c for _, _, c in order]))
        return cls(dictionaries, weights, intercept)

    def score(self, docs: DataFrame) -> DataFrame:
        """The columns of ``docs`` and ``toxicity``."""
        dictionaries, weights, intercept = self.dictionaries, self.weights, self.intercept
        if dictionaries is None:
            return docs.withColumn("toxicity", F.lit(0.0))
        at = docs.columns.index("text")

        def apply(batches):
            for batch in batches:
                raw, offsets = vectors.column_bytes(batch.column(at))
                scores = np.zeros(batch.num_rows)
                for i, j in vectors.slices(offsets):
                    x = _savings(dictionaries).features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    scores[i:j] = 1 / (1 + np.exp(-np.clip(x @ weights + intercept, -500, 500)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "toxicity"])

        from pyspark.sql.types import DoubleType, StructType

        return docs.mapInArrow(apply, StructType([*docs.schema.fields]).add("toxicity", DoubleType()))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint"), "text")
    model = ToxicityModel.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = model.score(docs)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
