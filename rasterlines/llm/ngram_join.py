"""Exact Jaccard self-join of documents on word n-grams, with connected components.

A document's set holds its distinct runs of ``size`` words (words lie between
white space; A-Z in lower case); fewer words make one run, no words an empty
set, which links with nothing.  Two documents link when
``den * |intersection| >= num * |union|``.

Steps:

1. A counting sketch over all n-grams of all documents gives the global order:
   rarest first, by count class, then by hash.  Collisions only blur the order,
   which stays one total order for all.
2. Documents of equal sets are one node.  A node's prefix - the n-grams of which
   any linked partner must have one - goes to buckets by n-gram.  Within each
   bucket every node is paired with the bucket's most central node only.
   Frequent n-grams are dealt out to several buckets by node; their central
   nodes meet in a second step.
3. Vertical partitioning: the global order is cut into fragments at pivots of
   equal weight.  Each pair's overlap is counted fragment by fragment and summed;
   pairs that the rarest fragment rules out do not go on to the others.
4. Linked pairs give components.  Where a bucket still holds nodes of several
   components, pairs across components that pass the length, position and
   distance bounds are verified the same way.  So no link between different
   components is lost, and no group is expanded into all its pairs.

Nulls: a null text has an empty set; a null doc_id is kept, its rows are nodes
like others, and a component's smallest doc_id is taken over non-null ones.
Repeated rows are members of one node.  Texts of any length are used whole.
Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectors
from .common import BROADCAST_ROWS, Scratch, connected_components, text_key, without

#: Bits of the sketch's index; the sketch has 4 * 2**bits bytes in each task, 2**bits on the way to the tasks.
SKETCH_BITS = 21
_BLOCK = 1 << 16
#: A bucket takes about 2**this nodes.
_BUCKET_BITS = 12


def text_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram hashes of each text, with repeats, and offsets by text."""
    low = vectors.LOWER[raw]
    starts, ends = vectors.word_spans(low, offsets, vectors.BETWEEN_SPACES)
    words = vectors.span_hashes(low, starts, ends)
    bounds = vectors.counts_in(starts, offsets)
    n_words = np.diff(bounds)
    found, at = vectors.grams(words, bounds, size)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        whole = np.array([vectors.gram_hashes(words[bounds[i] : bounds[i + 1]], n_words[i])[0] + np.uint64(n_words[i]) for i in short], np.uint64)
        found = np.insert(found, at[short], whole)
        more = np.zeros(len(at), np.int64)
        more[short + 1] = 1
        at = at + np.cumsum(more)
    return found, at


def count_classes(docs: DataFrame, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(log2 class of each sketch cell, n-grams counted in each class)."""

    def count(batches):
        vectors.release()
        cells = np.zeros(1 << bits, np.int32)
        for batch in batches:
            raw, offsets = vectors.column_bytes(batch.column(0))
            for i, j in vectors.slices(offsets):
                found, _ = text_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                cells += np.bincount((found & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits).astype(np.int32)
        for b in range(0, 1 << bits, _BLOCK):
            part = cells[b : b + _BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b // _BLOCK], pa.int32()), pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())], ["block", "cells"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zstandard.decompress(cells), np.int32)
                total[block] = total.get(block, 0) + part.astype(np.int64)
        for block, cells in total.items():
            classes = np.where(cells > 0, np.log2(np.maximum(cells, 1)), 0).astype(np.uint8)
            weight = np.bincount(classes, cells, 64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([classes.tobytes()], pa.binary()), pa.array([weight.tolist()], pa.list_(pa.int64()))], ["block", "classes", "weight"])

    rows = docs.select("text").mapInArrow(count, "block int, cells binary").repartition("block").mapInArrow(add, "block int, classes binary, weight array<bigint>").collect()
    classes, weight = np.zeros(1 << bits, np.uint8), np.zeros(64, np.int64)
    for r in rows:
        classes[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(r.classes, np.uint8)
        weight += np.array(r.weight)
    return classes, weight


def pivots(weight: np.ndarray, fragments: int) -> np.ndarray:
    """Where to cut the order so that each fragment has an equal share of all n-grams."""
    if not weight.sum():
        return np.empty(0, np.uint64)
    ends = np.cumsum(weight)
    out = []
    for k in range(1, fragments):
        share = weight.sum() * k / fragments
        c = int(np.searchsorted(ends, share, "right"))
        within = (share - (ends[c] - weight[c])) / weight[c]
        out.append((c << 58) + int(within * (1 << 58)))
    return np.array(out, np.uint64)


class NodeSets:
    """Makes each text's node and its n-grams in global order."""

    def __init__(self, size: int, classes: np.ndarray):
        self.size, self.classes = size, classes

    def __call__(self, raw: np.ndarray, offsets: np.ndarray):
        """Yields (text, node, ordered distinct n-grams), the latter as class << 58 | hash >> 6."""
        found, at = text_sets(raw, offsets, self.size)
        rank = self.classes[(found & np.uint64(len(self.classes) - 1)).astype(np.int64)].astype(np.uint64)
        found = rank << np.uint64(58) | found >> np.uint64(6)
        for i in range(len(offsets) - 1):
            grams = np.unique(found[at[i] : at[i + 1]])
            node = vectors.mix(np.add.reduce(vectors.mix(grams & np.uint64((1 << 58) - 1)), keepdims=True) + np.uint64(len(grams))) if len(grams) else None
            yield i, None if node is None else int(node.view(np.int64)[0]), grams


def prefixes(docs: DataFrame, size: int, classes: np.ndarray, num: int, den: int) -> DataFrame:
    """doc_id, key (hash of the text), n, node and prefix of each row; prefix is null where this task has sent the node's before.

    A prefix entry is (n-gram, its place in the node's order).  ``central`` is small for
    nodes whose n-grams are frequent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def make(batches):
        vectors.release()
        sets, sent = NodeSets(size, shared.value), set()
        for batch in batches:
            raw, offsets = vectors.column_bytes(batch.column(1))
            for i, j in vectors.slices(offsets):
                ns, nodes, central, tokens = [], [], [], []
                for _, node, grams in sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    n = len(grams)
                    ns.append(n)
                    nodes.append(node)
                    if not n or node in sent:
                        tokens.append(None)
                        central.append(0)
                    else:
                        sent.add(node)
                        tokens.append(grams[: n + num * n // -den + 1].view(np.int64))
                        central.append(1023 - int(16 * (grams >> np.uint64(58)).mean()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(central, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["doc_id", "key", "n", "node", "central", "prefix"])

    return docs.select(F.col("doc_id").cast("bigint"), "text", text_key()).mapInArrow(make, "doc_id bigint, key bigint, n bigint, node bigint, central bigint, prefix array<bigint>")


def partial_overlaps(pairs: DataFrame, members: DataFrame, docs: DataFrame, size: int, classes: np.ndarray, cuts: np.ndarray, fragments: range, scratch: Scratch, name: str) -> DataFrame:
    """a, b, and over these fragments of the order the n-grams that both (overlap), a (part_a) and b (part_b) have.

    Texts of the nodes at hand are read again for their sets.  ``b`` with many
    partners is dealt out by a salt.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def cut(batches):
        vectors.release()
        sets = NodeSets(size, shared.value)
        for batch in batches:
            raw, offsets = vectors.column_bytes(batch.column(0))
            for i, j in vectors.slices(offsets):
                nodes, numbers, tokens = [], [], []
                for _, node, grams in sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    if node is not None:
                        parts = np.split(grams, np.searchsorted(grams, cuts))
                        for f in fragments:
                            nodes.append(node)
                            numbers.append(f)
                            tokens.append(parts[f].tobytes() if f < len(parts) else b"")
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(tokens, pa.binary())], ["node", "fragment", "tokens"])

    def count(batches):
        at = held = last = None
        for batch in batches:
            out: list[tuple] = []
            for b, fragment, salt, a, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a is None:
                    at, held, last = (b, fragment, salt), np.frombuffer(tokens, np.uint64), None
                elif at == (b, fragment, salt) and a != last:
                    last = a
                    mine = np.frombuffer(tokens, np.uint64)
                    n = 0
                    if len(held):
                        where = np.searchsorted(held, mine)
                        where[where == len(held)] = 0
                        n = int(np.count_nonzero(held[where] == mine))
                    out.append((a, b, n, len(mine), len(held)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n", "in_a", "in_b"])

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    one = members.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("one")).select(F.col("one.doc_id").alias("_one_id"), F.col("one.key").alias("_one_key")).distinct()
    one = _sized(scratch.keep(one, f"{name}-wanted"))
    segments = docs.select("doc_id", "text").join(one, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_one_id")) & (text_key() == F.col("_one_key")), "left_semi").select("text").mapInArrow(cut, "node bigint, fragment int, tokens binary")
    sides = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(1024)).cast("int").alias("salts"))
    roles = (
        pairs.join(sides, "b")
        .select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.col("a"))
        .union(sides.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("a")))
    )
    roles = _sized(scratch.keep(roles, f"{name}-roles"))
    rows = segments.join(roles, "node").select("b", "fragment", "salt", "a", "tokens")
    rows = rows.repartition("b", "fragment", "salt").sortWithinPartitions("b", "fragment", "salt", F.asc_nulls_first("a"))
    partial = rows.mapInArrow(count, "a bigint, b bigint, n bigint, in_a bigint, in_b bigint")
    return partial.groupBy("a", "b").agg(F.sum("n").alias("overlap"), F.sum("in_a").alias("part_a"), F.sum("in_b").alias("part_b"))


def _sized(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def linked_pairs(pairs: DataFrame, members: DataFrame, docs: DataFrame, size: int, classes: np.ndarray, cuts: np.ndarray, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that link.

    The rarest fragment is counted first: a pair goes on to the others only if
    its overlap there and all of what is left would be enough.
    """
    how = (members, docs, size, classes, cuts)
    least = F.ceil((F.col("n_a") + F.col("n_b")) * num / F.lit(num + den))
    first = partial_overlaps(pairs, *how, range(1), scratch, f"{name}-first")
    hopeful = pairs.join(first, ["a", "b"]).where(F.col("overlap") + F.least(F.col("n_a") - F.col("part_a"), F.col("n_b") - F.col("part_b")) >= least)
    hopeful = scratch.keep(hopeful.select("a", "b", "n_a", "n_b", F.col("overlap").alias("so_far")), f"{name}-hopeful")
    rest = partial_overlaps(hopeful, *how, range(1, len(cuts) + 1), scratch, f"{name}-rest").select("a", "b", "overlap")
    total = hopeful.join(rest, ["a", "b"], "left").withColumn("overlap", F.col("so_far") + F.coalesce("overlap", F.lit(0)))
    return scratch.keep(total.where(F.col("overlap") * den >= (F.col("n_a") + F.col("n_b") - F.col("overlap")) * num).select("a", "b"), f"{name}-links")


def _length_bound(num: int, den: int):
    return F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num


def _prefix_bound(n_a: str, n_b: str, place_a: str, place_b: str, num: int, den: int):
    """Whether an n-gram at these places is in both prefixes that this pair's sizes call for.

    A linked pair overlaps in at least num / (num + den) of both sizes together,
    and so shares an n-gram before that many last ones of either.
    """
    least = F.ceil((F.col(n_a) + F.col(n_b)) * num / F.lit(num + den))
    return (F.col(place_a) <= F.col(n_a) - least) & (F.col(place_b) <= F.col(n_b) - least)


def _star(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its bucket's most central node as ``b``."""
    w = Window.partitionBy(*keys).orderBy("central", "a").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"b": F.first("a").over(w), "n_b": F.first("n_a").over(w), "place_b": F.first("place").over(w)})


def jaccard_components(docs: DataFrame, scratch: Scratch, size: int = 5, num: int = 80, den: int = 100, fragments: int = 4, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of each row; also key (hash of the text) and component (null: empty set)."""
    spark = docs.sparkSession
    classes, weight = count_classes(docs, size, sketch_bits)
    cuts = pivots(weight, fragments)
    members = scratch.keep(prefixes(docs, size, classes, num, den), "members")

    info = F.expr("central << 53 | n << 27 | place")
    index = members.where("prefix is not null").select(F.posexplode("prefix").alias("place", "token"), "node", "n", "central").select("token", F.col("node").alias("a"), info.alias("info"))
    bucket = F.expr(f"pmod(a, shiftleft(1L, greatest(0, cast(shiftrightunsigned(token, 58) as int) + 1 - {_BUCKET_BITS})))")
    dealt = index.select("token", bucket.alias("bucket"), "a", "info").repartition("token", "bucket")
    dealt = dealt.withColumns({"central": F.expr("info >> 53"), "n_a": F.expr("info >> 27 & 67108863"), "place": F.expr("info & 134217727")})
    first = _star(dealt, ["token", "bucket"]).where(f"a <> b or shiftrightunsigned(token, 58) >= {_BUCKET_BITS}")
    first = scratch.keep(first.select("token", "a", "b", "n_a", "n_b", "place", "place_b", "central"), "buckets")
    second = _star(first.where("a = b").select("token", "a", "n_a", "central", "place"), ["token"])
    columns = ["token", "a", "b", "n_a", "n_b", "place", "place_b"]
    paired = first.select(*columns).union(second.select(*columns)).where("a <> b")

    near = paired.where(_length_bound(num, den) & _prefix_bound("n_a", "n_b", "place", "place_b", num, den))
    pairs = scratch.keep(near.select("a", "b", "n_a", "n_b").distinct(), "pairs-1")
    links = linked_pairs(pairs, members, docs, size, classes, cuts, num, den, scratch, "1")
    found = connected_components(spark, links, scratch, "components-1")
    first_found = scratch.keep(found, "found-1")

    part = lambda df, c: df.join(first_found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")), c, "left").withColumn(f"{c}_part", F.coalesce(f"{c}_part", c))
    apart = part(part(paired.select("a", "b").distinct(), "a"), "b").where("a_part <> b_part").select("a", "b")
    mixed = paired.join(apart, ["a", "b"], "left_semi").select("token").distinct()
    both = first.join(mixed, "token", "left_semi")
    both = both.select("token", "a", "n_a", "place").union(both.select("token", "b", "n_b", "place_b")).distinct()
    rows = part(both, "a").withColumnRenamed("a_part", "part")
    rows = scratch.keep(rows, "mixed")
    most = rows.groupBy("token", "part").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    rows = scratch.keep(rows.join(most, "token").withColumn("odd", F.col("part") != F.col("main")).drop("main"), "odd")
    left = rows.where("odd").select("token", *(F.col(c).alias(f"x_{c}") for c in ("a", "n_a", "place", "part")))
    cross = left.join(rows, "token").where("x_part <> part and (not odd or x_a < a)")
    cross = cross.where((F.least("x_n_a", "n_a") * den >= F.greatest("x_n_a", "n_a") * num) & _prefix_bound("x_n_a", "n_a", "x_place", "place", num, den))
    swap = F.col("x_a") < F.col("a")
    cross = cross.select(F.least("x_a", "a").alias("a"), F.greatest("x_a", "a").alias("b"), F.when(swap, F.col("x_n_a")).otherwise(F.col("n_a")).alias("n_a"), F.when(swap, F.col("n_a")).otherwise(F.col("x_n_a")).alias("n_b"), F.when(swap, F.col("x_place")).otherwise(F.col("place")).alias("i"), F.when(swap, F.col("place")).otherwise(F.col("x_place")).alias("j"))
    cross = cross.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("k"), F.max("i").alias("i"), F.max("j").alias("j"))
    # All n-grams that these prefixes share are counted in k, the last of them at places i and j.
    bound = F.col("k") + F.least(F.col("n_a") - F.col("i") - 1, F.col("n_b") - F.col("j") - 1)
    cross = cross.where((F.col("n_a") + F.col("n_b") - bound) * num <= bound * den).select("a", "b", "n_a", "n_b")
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = scratch.keep(cross.join(done, ["a", "b"], "left_anti"), "pairs-2")
    if not cross.isEmpty():
        more = linked_pairs(cross, members, docs, size, classes, cuts, num, den, scratch, "2")
        found = connected_components(spark, links.union(more), scratch, "components-2")

    nodes = members.select("doc_id", "key", F.col("n").alias("n_shingles"), "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = nodes.where("node is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = nodes.join(smallest, "component", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key", "component")


def one_of_each_group(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays for each component: smallest (doc_id, hash of the text).

    Texts without words all stay.
    """
    rows = scratch.keep(jaccard_components(docs, scratch).select("doc_id", "key", "component").where("component is not null"), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    kept = rows.groupBy("component").agg(F.min(place).alias("kept"))
    gone = rows.join(kept, "component").where(~place.eqNullSafe(F.col("kept")))
    left = without(docs, gone, scratch, "gone")
    twice = scratch.keep(rows.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    if twice.isEmpty():
        return left
    # Rows alike in doc_id and text: any one of them stays.
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_twice_id")) & (text_key() == F.col("_twice_key"))
    twice = twice.select(F.col("doc_id").alias("_twice_id"), F.col("key").alias("_twice_key"))
    once = left.join(twice, same, "left_semi").withColumn("_twice_key", text_key()).dropDuplicates(["doc_id", "_twice_key"]).drop("_twice_key")
    return left.join(twice, same, "left_anti").unionByName(once)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, Scratch(spark, "ngram-join")).drop("key", "component")


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN sizes s ON s.doc_id = x.doc_id JOIN sizes t ON t.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, s.n, t.n HAVING 100 * count(*) >= 80 * (s.n + t.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) r USING (doc_id)
"""
