"""Centroid clustering against plain integer arithmetic."""

import hashlib
import math
import random

import pytest

pytest.importorskip("pagewright.llm")

from pagewright.llm import centroid_clusters as cc
from pagewright.llm import queries

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, dims, clusters=40, rounds=5):
    kept = [(i, [math.floor(256 * x) if abs(x) < 2**40 else int(x) * 256 for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            if mine := [v for (_, v), c in zip(kept, own) if c == k]:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [near(v) for _, v in kept]
    total = sum(d for d, _ in found)
    long = lambda x: x if x < 1 << 63 else None
    return [(i, k, long(d), long(sum(e for e, j in found if j == k)), long(total), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, found)]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e7, 1e30])
def test_exact(spark, scale):
    rng = random.Random(scale)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) * (scale if rng.random() < 0.2 else 1) for _ in range(8)]) for i in range(300)]
    rows += [(i % 7, [0.5] * 8) for i in range(200)] + [(None, [1.0] * 8)] * 2
    rows += [(900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 7 + [None]), (904, [float("nan")] * 8), (905, [float("inf")] + [0.0] * 7)]
    got = cc.cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), clusters=9, rounds=3, dimensions=8).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 8, 9, 3), key=key)


def test_limits_are_exact():
    import numpy as np

    rng = np.random.default_rng(3)
    for most in (cc.GEMM_MOST, cc.GEMM_MOST + 1, cc.LONG_MOST, cc.LONG_MOST + 1, 1 << 61):
        rows = rng.choice([-most, most, most - 1, 1], (6, cc.DIMENSIONS))
        other = np.concatenate([-rows[:2], rng.integers(-9, 9, (2, cc.DIMENSIONS))])
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c)) for c in other] for x in rows]
        assert cc.distances(rows, other).tolist() == want
        sums = cc.cluster_sums(rows, np.array([0, 1, 0, 0, 2, 0]), 3)
        assert sums.tolist() == [[sum(int(rows[i][j]) for i in own) for j in range(cc.DIMENSIONS)] for own in ((0, 2, 3, 5), (1,), (4,))]


def test_few_none_and_extra_columns(spark):
    assert cc.cluster_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, [float(i)] * 64, 1, "x") for i in range(3)]
    got = cc.cluster_vectors(spark.createDataFrame(rows, SCHEMA + ", cluster int, vector string")).collect()
    assert sorted(r.vec_id for r in got) == [0, 1, 2] and all(r.distance == 0 == r.inertia for r in got) and len({r.cluster for r in got}) == 3


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, queries.op12_centroids(spark, sf_dir).collect())) == sorted(brute(rows, 64))


def test_vectors_are_not_shuffled(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    plan = cc.cluster_vectors(vectors)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
