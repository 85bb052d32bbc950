"""Overtaken results on streams, and what may be told of streams."""

import json
import time
from datetime import datetime, timedelta

from pagewright.streaming import late, metrics

START = datetime(2026, 3, 1)
RESULT = "document_id string, request_id string, started_at timestamp, at timestamp, segment_id string"
REQUEST = "document_id string, request_id string, started_at timestamp"


def at(seconds):
    return START + timedelta(seconds=seconds)


REQUESTS = [("d1", "r1", at(0)), ("d1", "r2", at(4)), ("d2", "r1", at(0)), ("d2", "r2", at(0)), ("d3", "r1", at(1)), ("d1", "r3", at(4.5))]
RESULTS = [("d1", "r1", at(0), at(2), "a"), ("d1", "r1", at(0), at(5), "b"), ("d1", "r3", at(4.5), at(6), "c"), ("d2", "r1", at(0), at(3), "d"), ("d2", "r2", at(0), at(3), "e"), ("d3", "r1", at(1), at(9), "secret text")]
WANT = {("a", None), ("b", "r2"), ("b", "r3"), ("c", None), ("d", "r2"), ("e", None), ("secret text", None)}


def test_on_tables(spark):
    got = late.overtaken(spark.createDataFrame(RESULTS, RESULT), spark.createDataFrame(REQUESTS, REQUEST)).collect()
    assert {(r.segment_id, r.overtaken_by) for r in got} == WANT and len(got) == len(WANT)


def test_on_streams_with_bounded_state_and_counts_alone(spark, tmp_path):
    told = []
    listener = metrics.Counts(told.append)
    spark.streams.addListener(listener)
    late_row = ("d9", "r1", at(0), at(1), "too late")
    steps = [(RESULTS[:3], REQUESTS[:3]), (RESULTS[3:], REQUESTS[3:]), ([("d8", "r1", at(900), at(901), "later")], [("d8", "r1", at(900))]), ([late_row], [("d9", "r9", at(902))]), ([("d8", "r1", at(990), at(1900), "last")], [("d8", "r1", at(1900))])]
    out = []
    try:
        for k, (results, requests) in enumerate(steps):
            for name, rows, schema in (("results", results, RESULT), ("requests", requests, REQUEST)):
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / name))
            read = lambda name, schema: spark.readStream.schema(schema).json(str(tmp_path / name))
            query = late.overtaken(read("results", RESULT), read("requests", REQUEST)).writeStream.queryName("late").foreachBatch(lambda rows, _: out.extend(rows.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
        for _ in range(50):
            if len([t for t in told if t["event"] == "end"]) >= len(steps):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    got = {(r.segment_id, r.overtaken_by) for r in out}
    assert got - {("later", None)} == WANT
    batches = [t for t in told if t["event"] == "batch"]
    assert sum(t["rows"] for t in batches) >= len(RESULTS) + len(REQUESTS) and sum(t["dropped"] for t in batches) >= 1
    assert batches[-1]["held"] <= 8
    assert all(set(t) <= {"event", "name", "batch", "rows", "held", "dropped", "ms", "failed"} for t in told)
    for word in ("secret", "d1", "r1", str(tmp_path)):
        assert word not in json.dumps(told)
