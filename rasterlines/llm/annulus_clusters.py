"""Centroid clustering with annulus search over integer vectors.

Vectors and centroids are integers, so sums, distances and ties are exact.  A
round sorts the centroids by norm.  A vector's distance to the centroid of the
nearest norm (the better of its two neighbours in norm) bounds the distance to
its nearest centroid from above, and by the triangle inequality only centroids
whose norm differs from the vector's by at most that bound can be as near: two
binary searches find them, and only they are compared, exactly, those on the
boundary included.  The bounds are widened by more than the rounding error of
the norms, so none is missed; of equally near centroids the smaller number wins.

Centroids start as the vectors with the smallest SHA-256 of ``<seed>:<vec_id>``.
A round is one pass over the vectors: each task adds up its vectors by cluster
and emits a row for each cluster, Spark adds those up.  What the driver and the
tasks share are the k centroids, whose number is a parameter.

Kept are vectors of exactly ``dim`` components, none null, NaN or infinite.  A
component x becomes floor(scale * x); those beyond 2**27 count as 2**27, so that
squared distances fit a long.  Fewer vectors than k: as many centroids as
vectors.  A null vec_id hashes as the empty string; of equal hashes the smaller
vector goes first.  Repeated vectors count as often as they are there.  An empty
centroid stays where it is.  Other columns are ignored.  An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

_MOST = 1 << 27
#: Vectors compared at a time.
_BLOCK = 4096


def integer_vectors(embeddings: DataFrame, column: str = "embedding", dim: int = 64, scale: int = 64) -> DataFrame:
    """vec_id and ``v`` (array of int) of the vectors kept."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = embeddings.where(F.coalesce((F.size(column) == dim) & finite, F.lit(False)))
    return kept.select(F.col("vec_id").cast("bigint"), F.transform(x, lambda c: F.greatest(F.lit(float(-_MOST)), F.least(F.lit(float(_MOST)), c * scale)).cast("double")).alias("_x")).select(
        "vec_id", F.transform("_x", lambda c: F.floor(c).cast("int")).alias("v")
    )


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in chosen], np.int64)


class Annulus:
    """Centroids sorted by norm; ``nearest`` compares each vector with those of its annulus only."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.compared = 0

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row."""
        number, distance = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
        for i in range(0, len(v), _BLOCK):
            number[i : i + _BLOCK], distance[i : i + _BLOCK] = self._block(v[i : i + _BLOCK])
        return number, distance

    def _squared(self, v: np.ndarray, at) -> np.ndarray:
        d = v - self.centroids[self.order[at]]
        self.compared += len(d)
        return np.einsum("ij,ij->i", d, d)

    def _block(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        right = np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)
        left = np.maximum(right - 1, 0)
        bound = np.sqrt(np.minimum(self._squared(v, left), self._squared(v, right)).astype(np.float64))
        slack = 1e-9 * (norm + bound) + 1e-6
        low = np.searchsorted(self.norms, norm - bound - slack, "left")
        high = np.searchsorted(self.norms, norm + bound + slack, "right")
        best, where = np.full(len(v), np.iinfo(np.int64).max), np.full(len(v), len(self.norms))
        for at in range(int(low.min()), int(high.max())):
            rows = np.flatnonzero((low <= at) & (at < high))
            if not len(rows):
                continue
            d, number = self._squared(v[rows], at), self.order[at]
            better = (d < best[rows]) | ((d == best[rows]) & (number < where[rows]))
            best[rows[better]], where[rows[better]] = d[better], number
        return where, best


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of each vector."""
    dim = centroids.shape[1]

    def apply(batches):
        search = Annulus(centroids)
        for batch in batches:
            number, distance = search.nearest(_matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(apply, "vec_id bigint, cluster int, distance bigint")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each the floor of its vectors' mean."""
    k, dim = centroids.shape

    def apply(batches):
        search, count, sums = Annulus(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            number, _ = search.nearest(v)
            count += np.bincount(number, minlength=k)
            for c in np.unique(number):
                sums[c] += v[number == c].sum(0)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    # A row for each task and cluster, then k * dim sums.
    parts = vectors.mapInArrow(apply, "cluster int, n bigint, sums array<bigint>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x"))
    total = each.groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = centroids.copy()
    for r in total:
        out[r.cluster, r["at"]] = int(r.x) // int(r.n)
    return out


def cluster(embeddings: DataFrame, scratch: Scratch, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of each vector kept; the centroids)."""
    vectors = scratch.keep(integer_vectors(embeddings, dim=dim, scale=scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return scratch.spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    assigned = scratch.keep(assign(vectors, centroids), "assigned")
    scratch.drop("vectors")
    return assigned, centroids


def op13_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    assigned, centroids = cluster(embeddings, Scratch(spark, "clusters"))
    # A row for each of the k clusters.
    sums = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    known = [(n, sums.get(n, 0), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for n, c in enumerate(centroids)]
    about = spark.createDataFrame(known, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("bigint").alias("inertia"), "centroid_sha256")


def _sql() -> str:
    nearest = """a{n} AS (
  SELECT vec_id, v, cluster, d FROM (
    SELECT k.vec_id, k.v, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (k.v[i::int] - c.c[i::int]) * (k.v[i::int] - c.c[i::int]))) AS d
    FROM kept k, c{n} c
  ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1
)"""
    moves = """m{n} AS (
  SELECT cluster, list(((x - ((x % n) + n) % n) // n)::bigint ORDER BY i) AS c FROM (
    SELECT cluster, i, sum(v[i::int])::hugeint AS x, count(*)::hugeint AS n FROM a{n}, range(1, 65) r(i) GROUP BY cluster, i
  ) GROUP BY cluster
),
c{next} AS (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN m{n} m USING (cluster))"""
    steps = [nearest.format(n=0)]
    for n in range(3):
        steps += [moves.format(n=n, next=n + 1), nearest.format(n=n + 1)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v AS c FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16),
{", ".join(steps)}
SELECT vec_id, cluster::int AS cluster, d::bigint AS distance, sum(d) OVER (PARTITION BY cluster)::bigint AS cluster_inertia, sum(d) OVER ()::bigint AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a3 JOIN c3 c USING (cluster)
"""


OP13_SQL = _sql()
