"""Embedding near-duplicates against all pairs."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("pagewright.llm")

import numpy as np

from pagewright.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, root int"


def all_pairs(rows, least=0.9):
    """(links, component) by row place, in double precision."""
    n = len(rows)
    unit = []
    for _, v, *_ in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        v = np.array(v, np.float32).astype(float) if ok else None
        unit.append(v / np.linalg.norm(v) if ok else None)
    up, links = list(range(n)), [0] * n

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0])
    return links, [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(n)]


def cluster(rng, spread, k, dim=16):
    center = rng.standard_normal(dim)
    return [(center + spread * rng.standard_normal(dim)).tolist() for _ in range(k)]


def test_all_links(spark):
    rng = np.random.default_rng(5)
    vectors = [v for spread, k in ((0.05, 60), (0.15, 40), (0.25, 30), (0.3, 30), (0.0, 9), (0.1, 2)) for v in cluster(rng, spread, k)]
    vectors += rng.standard_normal((100, 16)).tolist() + cluster(rng, 0.05, 5, 8)
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1e-30] * 16, [1e30] * 16]
    rng.shuffle(vectors)
    rows = [(7 * i + 3, v, 0, 1) for i, v in enumerate(vectors)] + [(None, vectors[0], 0, 1), (3, vectors[0], 0, 1), (-5, vectors[1], 0, 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), window=16, passes=12).collect()
    links, component = all_pairs(rows)
    want = sorted((str(r[0]), n, str(c), r[0] == c) for r, n, c in zip(rows, links, component))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == want


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = [(i, v, 0, 0) for i, v in enumerate(cluster(rng, 0.22, 120))]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), passes=8).collect()
    links, component = all_pairs(rows)
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(links))
    assert {r.vec_id: r.component_id for r in got} == dict(enumerate(component))


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows, n = [], 600
    for i in range(n):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        angle = np.arccos(0.901)
        rows += [(2 * i, a.tolist(), 0, 0), (2 * i + 1, (np.cos(angle) * a + np.sin(angle) * b).tolist(), 0, 0)]
    rows += [(10_000 + i, v, 0, 0) for i, v in enumerate(rng.standard_normal((2000, 64)).tolist())]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    found = sum(r.n_links for r in got if r.vec_id < 10_000) / (2 * n)
    assert found >= 0.95
    assert all(r.n_links == 0 for r in got if r.vec_id >= 10_000)


@pytest.mark.parametrize("mutual", [0.7, 0.8, 0.85])
def test_recall_in_a_hot_group(spark, mutual):
    """A third of the vectors are similar to each other below the threshold, and hold pairs right above it."""
    rng, dim, pairs = np.random.default_rng(9), 64, 750
    center = np.eye(dim)[0]
    aside = rng.standard_normal((2, pairs, dim))
    aside[:, :, 0] = 0
    aside /= np.linalg.norm(aside, axis=2, keepdims=True)
    # of two vectors sqrt(mutual) * center + sqrt(1 - mutual) * aside, the cosine is mutual + (1 - mutual) * their asides' cosine
    near = (0.902 - mutual) / (1 - mutual)
    other = aside[1] - aside[0] * (aside[0] * aside[1]).sum(axis=1, keepdims=True)
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    other = near * aside[0] + np.sqrt(1 - near**2) * other
    hot = [(np.sqrt(mutual) * center + np.sqrt(1 - mutual) * a).tolist() for pair in zip(aside[0], other) for a in pair]
    rows = [(i, v, 0, 0) for i, v in enumerate(hot + rng.standard_normal((4 * pairs, dim)).tolist())]
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(pairs)) / pairs >= 0.95


def test_windows_do_not_depend_on_the_number_of_partitions(spark):
    rng = np.random.default_rng(10)
    vectors = [v for _ in range(40) for v in cluster(rng, 0.22, 5)]
    classes = spark.createDataFrame(list(enumerate(vectors)), "cid long, vector array<float>")
    was, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in ("1", "100"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            joined = embedding_dedup._Union()
            links, crowded = embedding_dedup.window_links(classes, len(vectors), range(2))
            for a, b in links.collect():
                joined.join(a, b)
            rows = embedding_dedup.signatures(classes, range(2)).groupBy("dim", "pass", F.shiftright("sign", embedding_dedup.BITS - embedding_dedup.run_bits(len(vectors))).alias("run")).count()
            assert sorted(map(tuple, crowded.collect())) == sorted(tuple(r) for r in rows.collect() if r["count"] > embedding_dedup.WINDOW)
            found.append([joined.find(x) for x in range(len(vectors))])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert found[0] == found[1] and len(set(found[0])) < len(vectors)


def test_places_are_ranges():
    rng = np.random.default_rng(12)
    cuts = sorted({(2, int(k), int(s), int(c)) for k, s, c in zip(rng.integers(0, 3, 40), rng.integers(0, 4, 40), rng.integers(0, 9, 40))})
    for k in range(3):
        sign, cid = rng.integers(0, 4, 60), rng.integers(0, 9, 60)
        got = embedding_dedup._place(2, k, sign, cid, cuts)
        assert got.tolist() == [sum(c <= (2, k, s, i) for c in cuts) for s, i in zip(sign.tolist(), cid.tolist())]


def test_signatures_are_computed_once(spark):
    """Apart from the sample, each vector is signed once for the windows, whatever the number of ranges."""
    signed, n = spark.sparkContext.accumulator(0), 12_000
    plain = spark.range(n).select(F.col("id").alias("cid"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.hash("id", k).cast("double")).alias("vector"))

    def count(batches):
        for batch in batches:
            signed.add(batch.num_rows)
            yield batch

    counted = plain.mapInArrow(count, plain.schema)
    links, _ = embedding_dedup.window_links(counted, n, range(2))
    assert signed.value == 2 * n  # once for the sample, once for all
    assert links.count() >= 0


def test_forest_of_a_matrix():
    rng = np.random.default_rng(3)
    for density in (0.0, 0.005, 0.02, 0.3, 1.0):
        linked = rng.random((90, 70)) < density

        def roots(edges):
            joined = embedding_dedup._Union()
            kept = [joined.join(i, 1000 + j) for i, j in edges]
            return all(kept), [joined.find(x) for x in [*range(90), *range(1000, 1070)]]

        spanning, found = roots(embedding_dedup._forest_of(linked))
        assert spanning and found == roots(zip(*map(np.ndarray.tolist, np.nonzero(linked))))[1]


def test_long_vectors(spark):
    rng = np.random.default_rng(12)
    base = rng.standard_normal((6, 3000))
    rows = [(k, (base[k // 2] + 0.2 * rng.standard_normal(3000) * (k % 2)).tolist(), 0, 0) for k in range(12)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: (1, k - k % 2) for k in range(12)}


def test_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passes_follow_the_number_of_vectors():
    assert embedding_dedup.passes_for(0) == embedding_dedup.passes_for(64) == 1
    assert embedding_dedup.passes_for(10**5) < embedding_dedup.passes_for(10**7) < 200
