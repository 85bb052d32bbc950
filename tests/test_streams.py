"""Streams: protocol validator, progress, admission."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagewright.operators.admission import Budget, budget_ledger, first_gate, rate_limit
from pagewright.streaming import admission, progress

RECORD = "array<struct<segment_id: string, score: double, relevant_probability: double, confidence: double>>"
MESSAGE = f"seq long, document_id string, request_id string, type string, evaluated int, total int, results {RECORD}, status string, evaluations {RECORD}, evaluated_segment_count int, request_count int, model string, elapsed_ms double, error struct<code: string, message: string>, sent array<string>, expected_total int"


def message(seq, kind="progress", evaluated=1, total=4, results=(("a", 1.0, 0.7, 0.5),), status="matched", count=4, elapsed=1.0, code="rate_limited", search="d", evaluations=None, model="m"):
    return (seq, search, "r", kind, evaluated, total, list(results) if results is not None else None, status, evaluations, count, 1, model, elapsed, (code, "said"), ["a", "b"], 4)


CASES = {
    "good": ([message(1), message(2, evaluated=4), message(3, "final")], [True] * 3),
    "falls": ([message(1, evaluated=3), message(2, evaluated=2), message(3, evaluated=3)], [True, False, True]),
    "after": ([message(1, "error"), message(2), message(3, "final")], [True, False, False]),
    "bad end": ([message(1, "final", count=3), message(2, "final"), message(3, "final")], [False, True, False]),
    "bounds": ([message(1, evaluated=5), message(2, evaluated=-1), message(3, total=5), message(4, evaluated=None)], [False] * 4),
    "records": ([message(1, results=[("z", 1.0, 0.7, 0.5)]), message(2, results=[("a", float("nan"), 0.7, 0.5)]), message(3, results=[("a", 1.0, 1.1, 0.5)]), message(4, results=None), message(5, results=[])], [False] * 4 + [True]),
    "fields": ([message(1, "final", status="other"), message(2, "final", elapsed=float("inf")), message(3, "final", model=None), message(4, "final", evaluations=[("z", 1.0, 0.5, 0.5)]), message(5, "error", code="nope"), message(6, "other")], [False] * 6),
}


def rows_of():
    return [(m[0], name, *m[2:]) for name, (messages, _) in CASES.items() for m in messages]


def test_the_batch_validator(spark):
    got = {}
    for r in sorted(progress.validate_batch(spark.createDataFrame(rows_of(), MESSAGE)).collect(), key=lambda r: r.seq):
        got.setdefault(r.document_id, []).append(r.ok)
    assert got == {name: oks for name, (_, oks) in CASES.items()}


def run_stream(spark, df, tmp_path, transform, batches, order=None):
    """The rows that ``transform`` makes of a stream with one file for each of ``batches``."""
    for k, part in enumerate(batches):
        part.coalesce(1).write.json(str(tmp_path / f"in{k}"))
    out = []
    for k in range(len(batches)):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        for f in (tmp_path / f"in{k}").glob("*.json"):
            f.rename(folder / f"{k}.json")
        stream = transform(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(folder)))
        query = stream.writeStream.foreachBatch(lambda rows, _: out.extend(rows.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return out


def test_the_stream_validator_keeps_state_between_batches(spark, tmp_path):
    rows = [r for r in rows_of() if r[1] in ("good", "falls", "after", "bad end")]
    df = spark.createDataFrame(rows, MESSAGE)
    got = run_stream(spark, df, tmp_path, progress.validate_stream, [df.where("seq = 1"), df.where("seq > 1")])
    by_name = {}
    for r in sorted(got, key=lambda r: r.seq):
        by_name.setdefault(r.document_id, []).append(r.ok)
    assert by_name == {name: CASES[name][1] for name in by_name} and len(by_name) == 4


ANSWER = "document_id long, request_id string, total int, segment_id string, doc_ordinal int, score double, relevant_probability double, error_code string"


def test_progress_then_one_terminal_message(spark, tmp_path):
    first = [(1, "r", 3, "a", 1, 1.0, 0.7, None), (1, "r", 3, "b", 2, 1.0, 0.9, None), (2, "r", 2, "x", 1, 1.0, 0.4, None), (3, "r", 2, "x", 1, 1.0, 0.9, None)]
    second = [(1, "r", 3, "c", 3, 1.5, 0.7, None), (2, "r", 2, "y", 2, 1.0, 0.1, None), (3, "r", 2, None, None, None, None, "provider_timeout")]
    third = [(1, "r", 3, "late", 4, 2.0, 1.0, None)]
    frames = [spark.createDataFrame(rows, ANSWER) for rows in (first, second, third)]
    got = run_stream(spark, frames[0], tmp_path, lambda s: progress.progress_stream(s, 10**9), frames)
    said = {}
    for r in got:
        said.setdefault(r.document_id, []).append((r.type, r.evaluated, r.results, r.status, r.error_code))
    assert said == {
        1: [("progress", 2, ["b", "a"], None, None), ("final", 3, ["b", "c", "a"], "matched", None)],
        2: [("progress", 1, [], None, None), ("final", 2, [], "uncertain", None)],
        3: [("progress", 1, ["x"], None, None), ("error", 1, None, None, "provider_timeout")],
    }


def test_stale_results_go_by_identity(spark):
    requests = spark.createDataFrame([(1, "old", 5), (1, "new", 9), (2, "only", 1)], "document_id long, request_id string, started_at long")
    results = requests.select("document_id", "request_id")
    assert sorted(r.request_id for r in progress.drop_stale(results, requests).collect()) == ["new", "only"]


def test_budget():
    ledger = Budget(100, 3, 15_000)
    assert ledger.reserve("a", 60, 1, 0) is None
    assert ledger.reserve("b", 50, 1, 1_000) == 14
    assert ledger.reserve("c", 40, 1, 1_000) is None
    assert ledger.reserve("d", 1, 1, 14_999) == 1
    assert ledger.reserve("d", 1, 1, 15_000) is None
    ledger.release("c")
    ledger.release("never")
    assert sorted(ledger.live) == ["d"]
    assert Budget(1, 1, 15_000).reserve("big", 2, 1, 0) == 15


EVENT = "budget string, event_id long, ts timestamp, action string, name string, tokens double, requests int"


def events(spark):
    rng, at, rows = random.Random(5), datetime(2024, 1, 1), []
    for k in range(300):
        at += timedelta(milliseconds=rng.randrange(3000))
        rows.append((rng.choice("ab"), k, at, rng.choice(["reserve", "reserve", "release"]), rng.choice("uvwxyz"), float(rng.randrange(50)), rng.randrange(3)))
    return spark.createDataFrame(rows, EVENT), rows


def plain_ledger(rows):
    out = {}
    for budget in "ab":
        live = []
        for _, k, at, action, name, tokens, requests in (r for r in rows if r[0] == budget):
            if action == "release":
                live = [x for x in live if x[0] != name]
                continue
            live = [x for x in live if x[3] > at]
            ok = sum(x[1] for x in live) + tokens <= 80 and sum(x[2] for x in live) + requests <= 4
            if ok:
                live = [x for x in live if x[0] != name] + [(name, tokens, requests, at + timedelta(milliseconds=15_000))]
            out[k] = ok
    return out


def test_the_ledger_and_its_stream(spark, tmp_path):
    df, rows = events(spark)
    want = plain_ledger(rows)
    got = budget_ledger(df, 80, 4, 15_000).collect()
    assert {r.event_id: r.admitted for r in got} == want
    assert all((r.wait_seconds is None) == r.admitted and (r.admitted or 1 <= r.wait_seconds <= 15) for r in got)
    parts = [df.where("event_id < 120"), df.where("event_id >= 120")]
    streamed = run_stream(spark, df, tmp_path, lambda s: admission.budget_stream(s, 80, 4, 15_000), parts)
    assert {r.event_id: (r.admitted, r.wait_seconds) for r in streamed} == {r.event_id: (r.admitted, r.wait_seconds) for r in got}


def test_rate_limit_and_gates(spark):
    at = datetime(2024, 1, 1)
    rows = [(k, at + timedelta(seconds=k), "c" if k % 2 else None) for k in range(100)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, client string")
    got = {r.event_id: r.limited for r in rate_limit(df).collect()}
    assert sum(got.values()) == 10 and not any(got[k] for k in range(0, 100, 2))
    gate = spark.range(1).select(first_gate(invalid_request=F.lit(True), rate_limited=F.lit(None).cast("boolean"), capacity_exhausted=F.lit(False)).alias("g")).first().g
    assert gate == "rate_limited"


def test_rate_counts_of_a_stream(spark, tmp_path):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(at + timedelta(seconds=k), "c") for k in range(50)], "ts timestamp, client string")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    out = []
    stream = admission.rate_counts(spark.readStream.schema(df.schema).json(str(tmp_path / "in")), 20)
    query = stream.writeStream.outputMode("update").foreachBatch(lambda rows, _: out.extend(rows.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.n, r.limited) for r in out] == [(50, 30)]


@pytest.mark.parametrize("name", ["file", "gone"])
def test_missing_folders_fail(spark, tmp_path, name):
    from pagewright.sources.items import read_items

    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_items(spark, str(tmp_path / name)).count()
