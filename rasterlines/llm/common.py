"""What the operators share: written intermediate tables and connected components.

Intermediate results that are read more than once, or that end an iteration,
are written as Parquet below the folder the cluster names in
``spark.checkpoint.dir``.  A written table cuts the lineage, survives the loss
of any executor and is visible to the driver and every executor alike.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one of our own only in local mode where none is set.

    A cluster that names none is an error: its machines wouldn't see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="rasterlines-")
    return _own_dirs[app]


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of texts that go to a Python worker at a time, in Arrow; a longer text goes alone.
BATCH_BYTES = 4 << 20


def limit_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, where it has the usual limit (64 MB): rows of text vary too much to be counted."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower() in ("-1", "64mb", "67108864b"):
        spark.conf.set(key, f"{BATCH_BYTES}b")


#: After so many written tables the driver's garbage is collected.
COLLECT_AFTER = 4


class Scratch:
    """Tables written for one run of an operator.

    ``keep`` writes a DataFrame and returns it as read back; ``drop`` removes a
    table that nothing lazy refers to any more.  zstd takes memory outside the
    JVM's heap, lz4_raw more disk.  Broadcast tables and shuffle files stay until
    the driver's garbage is collected, and its heap grows meanwhile; so that is
    done every few tables.
    """

    def __init__(self, spark: SparkSession, name: str, compression: str = "zstd"):
        self.spark, self.compression, self.kept = spark, compression, 0
        limit_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", compression or self.compression).parquet(path)
        self.kept += 1
        if self.kept % COLLECT_AFTER == 0:
            self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Up to this many rows go to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def text_key():
    """With doc_id, what tells the rows of a table of documents apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``docs`` without the rows whose (doc_id, key) is in ``gone``; null doc_ids match each other."""
    gone = scratch.keep(gone.select(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key")).distinct(), name)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_gone_id")) & (text_key() == F.col("_gone_key")), "left_anti")


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Smallest node reachable from every node that an edge touches.

    ``edges`` has columns ``a`` and ``b`` (bigint, no nulls; order, repetition
    and self-loops do not matter).  Returns ``node, component``.  Alternating
    large-star and small-star steps, each one shuffle of the edge list, halve
    the depth of the remaining trees; edges are written after each round, until
    every node has one edge, to a node that has none.
    An empty edge list gives an empty result.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = scratch.keep(edges, f"{name}-0")
    step = 0
    while True:
        # Large star: every neighbour above a node goes to the smallest of the node and its neighbours.
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large, f"{name}-{step}-large")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        step += 1
        edges = scratch.keep(small, f"{name}-{step}")
        ends = edges.selectExpr("a node", "1 up", "0 down").union(edges.selectExpr("b", "0", "1")).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        unfinished = ends.where("up + down > 1").count()
        scratch.drop(f"{name}-{step - 1}-large")
        scratch.drop(f"{name}-{step - 1}")
        if not unfinished:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
