"""Shared storage and bounded batches."""

import os

import pytest

pytest.importorskip("pagewright.llm")

import pyarrow as pa

from pagewright.llm import common, simhash_dedup
from pagewright.sources import storage


def test_batches_are_bounded_by_rows_and_bytes():
    texts = ["x" * n for n in (10, 10, 5000, 10, 10, 10)]
    batch = pa.RecordBatch.from_pydict({"t": texts})
    parts = list(common.bounded([batch, batch.slice(0, 0)], rows=2, most=100))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows <= 2 for p in parts) and [p.num_rows for p in parts if p.nbytes > 100] == [1]


def test_tables_can_be_removed(spark):
    before = common.written(spark)
    one, two = common.materialize(spark.range(5), "t"), common.materialize(spark.range(6), "t")
    where = [t._pagewright_path.removeprefix("file://") for t in (one, two)]
    assert one.count() == 5 and all(map(os.path.exists, where))
    common.discard(one)
    assert not os.path.exists(where[0]) and two.count() == 6
    common.release(spark, keep=before)
    assert not os.path.exists(where[1]) and common.written(spark) == before


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
    Context.getCheckpointDir = lambda self: "hdfs://shared/x"
    assert storage.shared_dir(Session()) == "hdfs://shared/x"
    for master, local in (("local", True), ("local[*]", True), ("local[4,2]", True), ("local-cluster[3,2,100]", False), ("yarn", False)):
        Context.master, Context.getCheckpointDir = master, lambda self: None
        if local:
            assert storage.shared_dir(Session()).startswith("file://")
        else:
            with pytest.raises(RuntimeError):
                storage.shared_dir(Session())


def test_settings_stay_as_they_were(spark):
    before = dict(spark.conf.getAll)
    docs = spark.createDataFrame([(k, f"a b c d {k}") for k in range(20)], "doc_id long, text string")
    simhash_dedup.near_duplicates(docs).count()
    assert dict(spark.conf.getAll) == before


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    before = common.written(spark)
    got = {r.node: r.root for r in common.connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90}
    assert len(common.written(spark)) == len(before) + 1
