"""Centroid clustering (k-means) in exact integers.

Vectors are scaled and rounded down to integers, so that every step is exact and no result depends on how rows are dealt out.
A worker holds a block of vectors and all centroids. Squared distances are |x|^2 - 2 x.c + |c|^2 in float64, the products
by one matrix product: with components of at most ``GEMM_MOST`` every partial sum, in whatever order, is an integer below 2^53, which
float64 holds exactly. Vectors or centroids beyond that take int64 differences up to ``LONG_MOST``, and Python's integers beyond that.

A round sums the vectors of each centroid: every partition yields one partial sum, and ``treeAggregate`` adds these up, so the driver
gets one sum for each centroid whatever the number of rows. No row is shuffled or collected, and the vectors are
read again each round instead of being stored. Equal vectors, or one cluster with most rows, cost no more than others.
"""

from __future__ import annotations

import hashlib
import pickle

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded

CLUSTERS = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
SEED = "2"
BLOCK_ROWS = 4096
_LONG = 1 << 63


def _limits(dimensions: int) -> tuple[int, int]:
    """The largest components for which dimensions * (2 * component)^2 stays below 2^53, and below 2^63."""
    return tuple(int(((1 << bits) // (4 * dimensions)) ** 0.5) - 1 for bits in (53, 63))


GEMM_MOST, LONG_MOST = _limits(DIMENSIONS)


def valid(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """True for a vector of so many components, none of them null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def scaled(values, scale: int = SCALE):
    """floor(scale * x) of a matrix of doubles: int64 if all fit, else Python's integers; exact for every finite double and a scale that is a power of two."""
    import numpy as np

    with np.errstate(over="ignore"):
        floors = np.floor(values * scale)
    if not values.size or np.abs(floors).max() < 2.0**62:
        return floors.astype(np.int64)
    whole = np.empty(values.shape, object)
    for at, x in np.ndenumerate(values):
        whole[at] = int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale))
    return whole


def _tier(matrix):
    """0, 1 or 2 for each row: small enough for products in float64, for differences in int64, or for neither."""
    import numpy as np

    gemm, long = _limits(matrix.shape[1])
    most = np.abs(matrix).max(axis=1)
    return (most > gemm).astype(np.int8) + (most > long).astype(np.int8)


def distances(rows, centroids):
    """Exact squared distances of integer ``rows`` (n, d) and ``centroids`` (k, d): int64, or Python's integers if any may exceed it."""
    import numpy as np

    of_rows, of_centroids = _tier(rows), _tier(centroids)
    large = max(of_rows.max(initial=0), of_centroids.max(initial=0)) == 2
    out = np.empty((len(rows), len(centroids)), object if large else np.int64)
    for i in np.unique(of_rows):
        for j in np.unique(of_centroids):
            a, b, at = rows[of_rows == i], centroids[of_centroids == j], np.ix_(of_rows == i, of_centroids == j)
            if i == j == 0:
                x, c = a.astype(np.float64), b.astype(np.float64)
                out[at] = ((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None]).astype(np.int64)
            else:
                kind = object if max(i, j) == 2 else np.int64
                a, b = a.astype(kind), b.astype(kind)
                out[at] = np.stack([((a - c) ** 2).sum(axis=1) for c in b], axis=1)
    return out


def nearest(rows, centroids):
    """(cluster, distance) of each row; of equally near centroids the first."""
    import numpy as np

    found = distances(rows, centroids)
    cluster = found.argmin(axis=1)
    return cluster, found[np.arange(len(rows)), cluster]


def cluster_sums(rows, cluster, clusters: int):
    """(clusters, d) exact sums of the rows of each cluster, as Python's integers."""
    import numpy as np

    if rows.dtype != object and np.abs(rows).max(initial=0) < (1 << 53) // max(1, len(rows)):
        member = np.zeros((clusters, len(rows)))
        member[cluster, np.arange(len(rows))] = 1.0
        return (member @ rows.astype(np.float64)).astype(np.int64).astype(object)
    out = np.zeros((clusters, rows.shape[1]), object)
    for k in np.unique(cluster):
        out[k] = rows[cluster == k].astype(object).sum(axis=0)
    return out


def _blocks(batches, dimensions: int, scale: int):
    """(batch, integer matrix) of the Arrow batches that a worker is handed (the vectors, all valid, come last)."""
    import numpy as np

    for batch in bounded(batches, BLOCK_ROWS):
        if batch.num_rows:
            yield batch, scaled(batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions), scale)


def _totals(vectors: DataFrame, centroids, dimensions: int, scale: int):
    """(sums, counts, inertias) by cluster of ``vectors`` (vector), each assigned to the nearest of ``centroids``."""
    import numpy as np

    k = len(centroids)

    def partial(batches):
        import pyarrow as pa

        sums, counts, inertia = np.zeros((k, dimensions), object), np.zeros(k, np.int64), np.zeros(k, object)
        for _, rows in _blocks(batches, dimensions, scale):
            cluster, distance = nearest(rows, centroids)
            sums += cluster_sums(rows, cluster, k)
            counts += np.bincount(cluster, minlength=k)
            inertia += cluster_sums(distance[:, None], cluster, k)[:, 0]
        yield pa.RecordBatch.from_pydict({"partial": pa.array([pickle.dumps((sums, counts, inertia))], pa.binary())})

    zero = np.zeros((k, dimensions), object), np.zeros(k, np.int64), np.zeros(k, object)
    add = lambda a, b: tuple(x + y for x, y in zip(a, b))
    parts = vectors.select("vector").mapInArrow(partial, "partial binary").rdd.map(lambda row: pickle.loads(row[0]))
    return parts.treeAggregate(zero, add, add)


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: str = SEED, scale: int = SCALE):
    """The integer vectors of the ``clusters`` rows whose SHA-256 of ``seed:vec_id`` is smallest, in its order; of equal hashes the smaller vector first. A null vec_id is written as nothing."""
    import numpy as np

    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "vector").orderBy("key", "vector").limit(clusters).collect()
    return scaled(np.array([row.vector for row in rows], float), scale) if rows else None


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED):
    """The centroids (k, d) after ``rounds`` rounds over ``vectors`` (vec_id, vector array<double>, all valid); None if there are none."""
    import numpy as np

    centroids = first_centroids(vectors, clusters, seed, scale)
    for _ in range(rounds if centroids is not None else 0):
        sums, counts, _ = _totals(vectors, centroids, dimensions, scale)
        moved = [[int(s) // int(n) for s in row] if n else [int(c) for c in old] for row, n, old in zip(sums, counts, centroids)]
        small = max(abs(x) for row in moved for x in row) < _LONG
        centroids = np.array(moved, np.int64 if small else object)
    return centroids


def assign(vectors: DataFrame, centroids, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance) of ``vectors`` (vec_id, vector array<double>, all valid); a distance beyond a long is null."""
    import pyarrow as pa

    def run(batches):
        for batch, rows in _blocks(batches, dimensions, scale):
            cluster, distance = nearest(rows, centroids)
            known = pa.array([int(d) if d < _LONG else None for d in distance] if distance.dtype == object else distance, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype("int32")), known], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "vector").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every sound row of ``vectors`` (vec_id, embedding; other columns are ignored).

    Rows whose vector is null, has another number of components than ``dimensions``, or a null or non-finite one are left out. Components become
    floor(scale * x). A round assigns every vector to its nearest centroid (ties: the first) and replaces each centroid that has vectors by their componentwise
    floor(sum / count); after the rounds vectors are assigned once more. Repeated rows count as often as they come, and may be several of the first centroids; fewer rows
    than ``clusters`` are all centroids; null vec_ids are kept. An empty table gives no rows. Distances and inertias beyond a long are null.
    """
    vector = F.col("embedding").cast("array<double>")
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(valid(F.col("vector"), dimensions))
    centroids = fit(sound, clusters, rounds, dimensions, scale, seed)
    if centroids is None:
        return sound.selectExpr("vec_id", "int(0) cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256").limit(0)
    _, _, inertia = _totals(sound, centroids, dimensions, scale)
    total, of_cluster = sum(map(int, inertia)), [int(x) for x in inertia]
    digest = [hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest() for row in centroids]
    long = lambda x: F.lit(x if x < _LONG else None).cast("long")
    place = F.col("cluster") + 1
    return assign(sound, centroids, dimensions, scale).select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(F.array(*map(long, of_cluster)), place).alias("cluster_inertia"),
        long(total).alias("inertia"),
        F.element_at(F.array(*map(F.lit, digest)), place).alias("centroid_sha256"),
    )
