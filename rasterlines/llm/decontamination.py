"""Benchmark decontamination: a prefix-filtered set join of item windows with document words.

Words are runs of digits, ASCII letters (A-Z in lower case) and all characters
beyond ASCII.  A window is ``window`` consecutive words of an item; an item
with fewer words, but not none, is one window.  A document word inside any
occurrence of a window is hit.

1. A window's tokens are its ``shingle``-word runs (shorter windows: the whole).
   Tokens are ordered by rarity, counted over all documents.
2. Containment must be exact, so a document has to have every token of a window;
   a prefix of one token, the rarest, is therefore enough to join on.
3. A match at a word position passes only if the whole window fits between the
   text's ends around it (length and position bounds).
4. The words of the item-sized stretch are compared with the window's exactly.

Benchmark windows go to the tasks in blocks of a fixed number of windows, so
what is broadcast is bounded whatever the benchmark's size; documents stay
where they are and are never shuffled as text.

Nulls: a null text has no words; an item with null id counts as item "null"
(its text is searched, its id is listed as the word null); a null doc_id stays.
Repeated rows give repeated results; equal item ids count once.  Other columns
are ignored.  An empty benchmark gives documents without hits; no documents
give no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .common import Scratch, limit_batches, text_key, without

#: Windows that a task holds at a time.
BLOCK_WINDOWS = 1 << 18

_HITS = "row bigint, key bigint, doc_id bigint, n_words bigint, hits array<int>, items array<string>"


def text_words(raw: np.ndarray, offsets: np.ndarray):
    """(lower-cased bytes, starts, ends, word hashes, offsets by text)."""
    low = vectors.LOWER[raw]
    starts, ends = vectors.word_spans(low, offsets, vectors.ALNUM)
    return low, starts, ends, vectors.span_hashes(low, starts, ends), vectors.counts_in(starts, offsets)


class Windows:
    """Distinct windows of a block of items, by token."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        self.shingle = shingle
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = _split(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.words = list(found)
        self.items = [sorted(found[w]) for w in self.words]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.tokens: dict[int, np.ndarray] = {}  # by token size: sorted distinct hashes
        self.own: list[tuple[int, np.ndarray]] = []  # of each window: token size and hash of each token
        for w in self.words:
            h = _hashes(w)
            size = min(shingle, len(w))
            self.own.append((size, vectors.gram_hashes(h, size)))
        for size in {s for s, _ in self.own}:
            self.tokens[size] = np.unique(np.concatenate([h for s, h in self.own if s == size]))

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Chooses each window's prefix: its rarest token, by (count, hash)."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, (size, hashes) in enumerate(self.own):
            n = counts[size][np.searchsorted(self.tokens[size], hashes)]
            at = int(np.lexsort([hashes, n])[0])
            by.setdefault(size, []).append((int(hashes[at]), at, k))
        self.prefix = {}
        for size, rows in by.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            self.prefix[size] = (keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))


def _split(text: str | None) -> list[bytes]:
    raw, offsets = vectors.column_bytes(pa.array([text], pa.string()))
    low, starts, ends, _, _ = text_words(raw, offsets)
    whole = low.tobytes()
    return [whole[a:b] for a, b in zip(starts, ends, strict=True)]


def _hashes(words: tuple[bytes, ...]) -> np.ndarray:
    raw = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return vectors.span_hashes(raw, ends - [len(w) for w in words], ends)


def _positions(held: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where in ``found``, where in sorted ``held``) of equal values."""
    at = np.searchsorted(held, found)
    at[at == len(held)] = 0
    hit = np.flatnonzero(held[at] == found)
    return hit, at[hit]


def token_counts(docs: DataFrame, windows: Windows) -> dict[int, np.ndarray]:
    """How often each token of the windows occurs in all documents."""
    tokens = windows.tokens
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def count(batches):
        vectors.release()
        totals = {size: np.zeros(len(held), np.int64) for size, held in shared.value.items()}
        for batch in batches:
            raw, offsets = vectors.column_bytes(batch.column(0))
            for i, j in vectors.slices(offsets):
                *_, words, bounds = text_words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for size, held in shared.value.items():
                    found, _ = vectors.grams(words, bounds, size)
                    if len(found):
                        totals[size] += np.bincount(_positions(held, found)[1], minlength=len(held))
        for size, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(at), pa.array(total[at])], ["size", "token", "n"])

    out = {size: np.zeros(len(held), np.int64) for size, held in tokens.items()}
    # One row at most for each token of a block of windows.
    for r in docs.select("text").mapInArrow(count, "size int, token bigint, n bigint").groupBy("size", "token").agg(F.sum("n").alias("n")).collect():
        out[r["size"]][r.token] = r.n
    return out


def find_windows(docs: DataFrame, windows: Windows) -> DataFrame:
    """row, key, doc_id, n_words, hit word positions and item ids of each row; ``docs`` numbers its rows in ``row``."""
    shared = docs.sparkSession.sparkContext.broadcast((windows.prefix, windows.sizes, windows.words, windows.items))

    def find(batches):
        vectors.release()
        prefix, sizes, window_words, items = shared.value
        for batch in batches:
            raw, offsets = vectors.column_bytes(batch.column(1))
            for i, j in vectors.slices(offsets):
                low, starts, ends, words, bounds = text_words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n_words = np.diff(bounds)
                hits: dict[int, set[int]] = {}
                named: dict[int, set[str]] = {}
                for size, (keys, places, ks) in prefix.items():
                    found = vectors.gram_hashes(words, size)
                    at = np.searchsorted(keys, found)
                    at[at == len(keys)] = 0
                    where = np.flatnonzero(keys[at] == found) if len(found) else np.empty(0, np.int64)
                    docs_at = np.searchsorted(bounds, where, "right") - 1
                    for p, d, a in zip(where.tolist(), docs_at.tolist(), at[where].tolist(), strict=True):
                        while a < len(keys) and keys[a] == found[p]:
                            k, begin = int(ks[a]), p - int(places[a])
                            end = begin + int(sizes[k])
                            if begin >= bounds[d] and end <= bounds[d + 1] and all(low[starts[begin + m] : ends[begin + m]].tobytes() == w for m, w in enumerate(window_words[k])):
                                hits.setdefault(d, set()).update(range(begin - int(bounds[d]), end - int(bounds[d])))
                                named.setdefault(d, set()).update(items[k])
                            a += 1
                rows = range(j - i)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in (2, 3, 0)), pa.array(n_words, pa.int64()), pa.array([sorted(hits.get(d, ())) for d in rows], pa.list_(pa.int32())), pa.array([sorted(named.get(d, ())) for d in rows], pa.list_(pa.string()))],
                    ["row", "key", "doc_id", "n_words", "hits", "items"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text", "row", text_key()).mapInArrow(find, _HITS)


def _blocks(benchmark: DataFrame, window: int, shingle: int, most: int):
    """The benchmark in blocks of about ``most`` windows, read one partition at a time."""
    items, size = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        items.append((r.item, r.text))
        size += 1 + r.text.count(" ")
        if size >= most:
            yield Windows(items, window, shingle)
            items, size = [], 0
    if items:
        yield Windows(items, window, shingle)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """key (hash of the text), doc_id, n_words, hits (word positions), items (ids as sorted strings) of each row."""
    limit_batches(docs.sparkSession)
    blocks = _blocks(benchmark, window, shingle, block_windows)
    one, two = next(blocks, Windows([], window, shingle)), next(blocks, None)
    if two is None:
        one.order(token_counts(docs, one) if one.words else {})
        return find_windows(docs.withColumn("row", F.lit(0).cast("bigint")), one).drop("row")
    scratch = Scratch(docs.sparkSession, "contamination")
    numbered = scratch.keep(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = []
    for k, windows in enumerate(chain([one, two], blocks)):
        windows.order(token_counts(numbered, windows))
        found.append(scratch.keep(find_windows(numbered, windows), f"block-{k}"))
    every = reduce(DataFrame.unionByName, found)
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return every.groupBy("row").agg(F.first("key").alias("key"), F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), joined("hits"), joined("items")).drop("row")


def clean_documents(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs."""
    return without(docs, contamination(docs, benchmark).where(F.size("hits") > 0), scratch, "contaminated")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS g, least(len(w), 10) AS m
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT m FROM windows
), places AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, sizes WHERE len(w) >= m)
), found AS (
  SELECT p.doc_id, p.i, p.m, x.item_id FROM places p JOIN windows x ON x.g = p.g AND x.m = p.m
), hit AS (
  SELECT doc_id, count(DISTINCT h) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS h FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
