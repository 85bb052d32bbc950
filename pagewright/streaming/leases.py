"""A budget in leases.

One ledger admits one reservation after another, so a budget of its own is one task. Here a budget is leased to shards: a reservation belongs to the shard of its name, each shard is a ledger
with the lease as its limits, and shards work apart. Between micro-batches leases are dealt anew: every shard keeps what it holds, hands back what it doesn't use, and what is free goes half in equal parts,
half by what was asked for in the last micro-batch. Leases never sum to more than the budget and no shard holds more than its lease, so the budget holds in whatever order shards work. With one shard it is the ledger.

What it costs: a shard may refuse what another one has room for, until leases are dealt again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright import limits
from pagewright.operators.admission import Budget
from pagewright.sources.storage import remove

SHARDS = 16
_LEASE, _LIVE, _EVENT = 0, 1, 2
_ROWS = "kind int, budget string, shard int, event_id long, at long, action string, name string, tokens double, requests long, ends long"
_OUT = "kind int, budget string, shard int, event_id long, admitted boolean, wait_seconds int, live int, held_tokens double, held_requests long, name string, tokens double, requests long, ends long"
_OUTCOME, _KEPT, _REPORT = 0, 1, 2


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def first_leases(budgets: DataFrame, shards: int, tokens: int, requests: int) -> DataFrame:
    """(budget, shard, tokens, requests): each of ``budgets`` (budget) in equal parts, the rest to the first shards."""
    part = lambda total: (F.floor(F.lit(total) / shards) + F.when(F.col("shard") < total % shards, 1).otherwise(0))
    return budgets.select("budget", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).select("budget", "shard", part(tokens).cast("double").alias("tokens"), part(requests).cast("long").alias("requests"))


def next_leases(reports: DataFrame, shards: int, tokens: int, requests: int) -> DataFrame:
    """(budget, shard, tokens, requests) from ``reports`` (budget, shard, held_tokens, held_requests, and what was asked for as tokens and requests), one row a shard."""
    every = Window.partitionBy("budget")

    def dealt(held, asked, total):
        free, wanted = F.greatest(F.lit(float(total)) - F.sum(held).over(every), F.lit(0.0)), F.sum(asked).over(every)
        part = F.when(wanted > 0, F.col(asked) / wanted).otherwise(1.0 / shards)
        return F.col(held) + F.floor(free * (0.5 / shards + 0.5 * part))

    return reports.select("budget", "shard", dealt("held_tokens", "tokens", tokens).cast("double").alias("tokens"), dealt("held_requests", "requests", requests).cast("long").alias("requests"))


def serve(leases: DataFrame, live: DataFrame, events: DataFrame, deadline_ms: int = limits.SEARCH_DEADLINE_MS) -> DataFrame:
    """A micro-batch of all shards, in one shuffle by budget and shard: outcomes of reservations (kind 0), reservations that are live afterwards (1), and each shard's report (2).

    ``leases``: budget, shard, tokens, requests. ``live``: budget, shard, name, tokens, requests, ends. ``events``: budget, shard, event_id, at, action, name, tokens, requests. A shard's rows pass by in order, and only its live reservations are held.
    """
    import pandas as pd

    names = _names(_ROWS)

    def rows(df, kind):
        return df.select(*[F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names])

    dealt = rows(leases, _LEASE).union(rows(live, _LIVE)).union(rows(events, _EVENT)).select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in _ROWS.split(", ")])
    dealt = dealt.repartition("budget", "shard").sortWithinPartitions("budget", "shard", "kind", "at", "event_id")

    def run(frames):
        key, ledger, asked, now = None, None, [0.0, 0], 0

        def closing():
            kept = [(n, *v) for n, v in ledger.live.items() if v[2] > now]
            held = sum(k[1] for k in kept), sum(k[2] for k in kept)
            for name, tokens, requests, ends in kept:
                yield _KEPT, *key, None, None, None, None, None, None, name, float(tokens), requests, ends
            yield _REPORT, *key, None, None, None, len(kept), float(held[0]), held[1], None, float(asked[0]), asked[1], None

        def table(found):
            return pd.DataFrame(found, columns=_names(_OUT)).astype({c: "Int64" for c in ("event_id", "held_requests", "requests", "ends")} | {"wait_seconds": "Int32", "live": "Int32", "admitted": "boolean"})

        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if key is None or (r.budget, r.shard) != key:
                    if key is not None:
                        out.extend(closing())
                    key, ledger, asked, now = (r.budget, r.shard), Budget(0, 0, deadline_ms), [0.0, 0], 0
                if r.kind == _LEASE:
                    ledger.tokens, ledger.requests = r.tokens, int(r.requests)
                elif r.kind == _LIVE:
                    ledger.live[r.name] = r.tokens, int(r.requests), int(r.ends)
                elif r.action == "release":
                    ledger.release(r.name)
                    now = int(r.at)
                else:
                    now, asked = int(r.at), [asked[0] + r.tokens, asked[1] + int(r.requests)]
                    wait = ledger.reserve(r.name, r.tokens, int(r.requests), now)
                    held = sum(v[0] for v in ledger.live.values()), sum(v[1] for v in ledger.live.values())
                    out.append((_OUTCOME, *key, int(r.event_id), wait is None, wait, len(ledger.live), float(held[0]), held[1], r.name, r.tokens, int(r.requests), None))
            yield table(out)
        if key is not None:
            yield table(list(closing()))

    return dealt.mapInPandas(run, _OUT)


def with_shards(events: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``events`` (budget, event_id, ts, action, name, tokens, requests) as ``serve`` takes them; a reservation and its release meet in the shard of their name. Events without a budget or a name are none."""
    known = events.where("budget is not null and name is not null")
    shard = F.pmod(F.xxhash64("budget", "name"), F.lit(shards)).cast("int")
    return known.select("budget", shard.alias("shard"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "action", "name", F.col("tokens").cast("double").alias("tokens"), F.col("requests").cast("long").alias("requests"))


def lease_batches(path: str, shards: int = SHARDS, tokens: int = limits.BUDGET_INPUT_TOKENS, requests: int = limits.BUDGET_REQUESTS, deadline_ms: int = limits.SEARCH_DEADLINE_MS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: serves a micro-batch of events, as ``with_shards`` takes them, from the state that the batch before left, and writes outcomes and its own state under ``path``.

    A batch's folder follows from the one before alone, so a batch that runs again replaces it with the same. Budgets are those seen so far; a new one starts with equal leases. Two states are kept.
    """

    def step(events: DataFrame, batch: int) -> None:
        spark, here = events.sparkSession, f"{path}/state/batch={batch}"
        events = with_shards(events, shards)
        before = max((n for n in _batches(spark, f"{path}/state") if n < batch), default=None)
        if before is None:
            leases, live = first_leases(events.select("budget").distinct(), shards, tokens, requests), None
        else:
            state = spark.read.schema(_OUT).parquet(f"{path}/state/batch={before}")
            reports = state.where(F.col("kind") == _REPORT)
            fresh = events.select("budget").distinct().join(reports.select("budget").distinct(), "budget", "left_anti")
            leases = next_leases(reports, shards, tokens, requests).union(first_leases(fresh, shards, tokens, requests))
            live = state.where(F.col("kind") == _KEPT)
        live = spark.createDataFrame([], _OUT) if live is None else live
        serve(leases, live.select("budget", "shard", "name", "tokens", "requests", "ends"), events, deadline_ms).write.mode("overwrite").parquet(here)
        written = spark.read.schema(_OUT).parquet(here)
        written.where(F.col("kind") == _OUTCOME).select("budget", "shard", "event_id", "admitted", "wait_seconds", "live", "held_tokens", "held_requests").write.mode("overwrite").parquet(f"{path}/outcomes/batch={batch}")
        remove(spark, *(f"{path}/state/batch={n}" for n in _batches(spark, f"{path}/state") if n < (before if before is not None else batch)))

    return step


def _batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches whose state is whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    done = lambda f: system.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))
    return [int(f.getPath().getName().removeprefix("batch=")) for f in system.listStatus(at) if done(f)]


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(budget, shard, event_id, admitted, wait_seconds, live, held_tokens, held_requests, batch) of all reservations served under ``path``."""
    return spark.read.parquet(f"{path}/outcomes")


def leased_stream(events: DataFrame, path: str, checkpoint: str, **options):
    """[I10-I13] A stream writer that admits the reservations of a stream of events; ``outcomes`` reads what it decided."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lease_batches(path, **options))
