"""Budgets in leases: never over the limit, and the ledger itself with one shard."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagewright.operators.admission import budget_ledger
from pagewright.streaming import leases

SCHEMA = "budget string, event_id long, ts timestamp, action string, name string, tokens double, requests int"
START = datetime(2026, 1, 1)
DEADLINE = 15_000


def events_of(rng, n, budgets=("a", "b")):
    """Reservations and releases in time order; some names come again while they are live."""
    out, at = [], 0
    for k in range(n):
        at += rng.randrange(0, 900)
        name = f"n{rng.randrange(40)}"
        out.append((rng.choice(budgets), k, START + timedelta(milliseconds=at), "release" if rng.random() < 0.25 else "reserve", name, float(rng.randrange(1, 60)), rng.randrange(1, 4)))
    return out


def run(spark, rows, path, shards, tokens, requests, batches):
    step = leases.lease_batches(path, shards, tokens, requests, DEADLINE)
    for k, part in enumerate(batches):
        step(spark.createDataFrame([rows[i] for i in part], SCHEMA), k)
    return leases.outcomes(spark, path).collect()


def split(n, parts):
    size = -(-n // parts)
    return [range(a, min(n, a + size)) for a in range(0, n, size)]


def test_one_shard_is_the_ledger(spark, tmp_path):
    rows = events_of(random.Random(1), 160)
    got = run(spark, rows, str(tmp_path), 1, 200, 9, split(160, 4))
    want = budget_ledger(spark.createDataFrame(rows, SCHEMA), 200, 9, DEADLINE).collect()
    assert sorted((r.budget, r.event_id, r.admitted, r.wait_seconds, r.live, r.held_tokens) for r in got) == sorted(map(tuple, want))


@pytest.mark.parametrize("seed", [2, 3])
def test_never_over_the_limit(spark, tmp_path, seed):
    """Whatever shards do at the same time: the admitted reservations that are live at any moment fit the budget."""
    rng = random.Random(seed)
    tokens, requests, n = 300, 11, 240
    rows = events_of(rng, n)
    parts = [rng.sample(part, len(part)) for part in split(n, 5)]  # rows of a batch come in any order
    got = {r.event_id: r for r in run(spark, rows, str(tmp_path), 4, tokens, requests, parts)}
    assert len(got) == sum(r[3] == "reserve" for r in rows)
    for budget in ("a", "b"):
        own = [r for r in rows if r[0] == budget]
        for moment in {r[2] for r in own}:
            live = {}
            for _, k, ts, action, name, used, calls in own:
                if ts > moment:
                    break
                if action == "release":
                    live.pop(name, None)
                elif got[k].admitted:
                    live[name] = used, calls, ts + timedelta(milliseconds=DEADLINE)
            now = [v for v in live.values() if v[2] > moment]
            assert sum(v[0] for v in now) <= tokens and sum(v[1] for v in now) <= requests
    assert sum(r.admitted for r in got.values()) > 20


def test_leases_are_dealt_by_need(spark):
    rows = [("a", 0, 10.0, 1, 90.0, 9), ("a", 1, 0.0, 0, 10.0, 1), ("a", 2, 40.0, 3, 0.0, 0), ("b", 0, 0.0, 0, 0.0, 0), ("b", 1, 0.0, 0, 0.0, 0), ("b", 2, 100.0, 5, 0.0, 0)]
    reports = spark.createDataFrame(rows, "budget string, shard int, held_tokens double, held_requests long, tokens double, requests long")
    got = {(r.budget, r.shard): (r.tokens, r.requests) for r in leases.next_leases(reports, 3, 100, 10).collect()}
    for budget in "ab":
        own = [got[budget, k] for k in range(3)]
        assert sum(x[0] for x in own) <= 100 and sum(x[1] for x in own) <= 10
    assert all(got[r[0], r[1]][0] >= r[2] and got[r[0], r[1]][1] >= r[3] for r in rows)
    assert got["a", 0][0] - 10 > got["a", 1][0] > got["a", 2][0] - 40 >= 0
    first = leases.first_leases(spark.createDataFrame([("a",)], "budget string"), 3, 100, 10).collect()
    assert sum(r.tokens for r in first) == 100 and sum(r.requests for r in first) == 10


def test_shards_are_tasks_of_their_own(spark):
    """The work of one budget is dealt to as many groups as it has shards, none with much more than its share."""
    rows = [("a", k, START, "reserve", f"n{k}", 1.0, 1) for k in range(4000)]
    shards = leases.with_shards(spark.createDataFrame(rows, SCHEMA), 16).groupBy("shard").count().collect()
    assert len(shards) == 16 and max(r["count"] for r in shards) < 2 * 4000 / 16


def test_a_stream_and_a_batch_that_runs_again(spark, tmp_path):
    rows = events_of(random.Random(5), 60)
    for k, part in enumerate(split(60, 3)):
        spark.createDataFrame([rows[i] for i in part], SCHEMA).coalesce(1).write.json(str(tmp_path / f"in{k}"))
    (tmp_path / "in").mkdir()
    path = str(tmp_path / "leases")
    for k in range(3):
        for f in (tmp_path / f"in{k}").glob("*.json"):
            f.rename(tmp_path / "in" / f"{k}.json")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = leases.leased_stream(stream, path, str(tmp_path / "state"), shards=3, tokens=150, requests=9, deadline_ms=DEADLINE).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    once = sorted(map(tuple, leases.outcomes(spark, path).collect()))
    leases.lease_batches(path, 3, 150, 9, DEADLINE)(spark.createDataFrame([rows[i] for i in split(60, 3)[2]], SCHEMA), 2)
    assert sorted(map(tuple, leases.outcomes(spark, path).collect())) == once and len(leases._batches(spark, f"{path}/state")) == 2


def test_odd_rows(spark, tmp_path):
    rows = [(None, 1, START, "reserve", "x", 1.0, 1), ("a", 2, START, "reserve", None, 1.0, 1), ("a", 3, START, "release", "never", 1.0, 1), ("a", 4, START, "reserve", "y", 1e9, 1)]
    got = run(spark, rows, str(tmp_path), 2, 10, 5, [range(4)])
    assert [(r.event_id, r.admitted) for r in got] == [(4, False)]
    leases.lease_batches(str(tmp_path), 2, 10, 5)(spark.createDataFrame([], SCHEMA), 1)
    assert leases.outcomes(spark, str(tmp_path)).where(F.col("batch") == 1).count() == 0
