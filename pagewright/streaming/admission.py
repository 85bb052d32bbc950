"""Admission on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import limits
from pagewright.operators.admission import LEDGER, Budget


def rate_counts(events: DataFrame, limit: int = limits.RATE_LIMIT, period: str = f"{limits.RATE_PERIOD_SECONDS} seconds", lateness: str = "10 minutes") -> DataFrame:
    """[I9] (window_start, client, n, limited) of a stream of events (ts, client); state of past windows goes with the watermark."""
    counts = events.where("client is not null").withWatermark("ts", lateness).groupBy(F.window("ts", period).alias("w"), "client").count()
    return counts.select(F.col("w.start").alias("window_start"), "client", F.col("count").alias("n"), F.greatest(F.col("count") - limit, F.lit(0)).alias("limited"))


def budget_stream(events: DataFrame, tokens: int = limits.BUDGET_INPUT_TOKENS, requests: int = limits.BUDGET_REQUESTS, deadline_ms: int = limits.SEARCH_DEADLINE_MS) -> DataFrame:
    """[I10-I13] ``budget_ledger`` on a stream: one state per budget, which holds its live reservations only."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, frames, state):
        ledger = Budget(tokens, requests, deadline_ms)
        if state.exists:
            ledger.live = {r[0]: (r[1], r[2], r[3]) for r in state.get[0]}
        rows = []
        for frame in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: (r.at, r.event_id)):
            if frame.action == "release":
                ledger.release(frame.name)
                continue
            wait = ledger.reserve(frame.name, frame.tokens, frame.requests, frame.at)
            rows.append((key[0], frame.event_id, wait is None, wait, len(ledger.live), sum(v[0] for v in ledger.live.values())))
        state.update(([(k, float(v[0]), int(v[1]), int(v[2])) for k, v in ledger.live.items()],))
        yield pd.DataFrame(rows, columns=["budget", "event_id", "admitted", "wait_seconds", "live", "held_tokens"]).astype({"wait_seconds": "Int32"})

    rows = events.select("budget", "event_id", "action", "name", F.col("tokens").cast("double").alias("tokens"), "requests", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("budget").applyInPandasWithState(run, LEDGER, "live array<struct<name: string, tokens: double, requests: long, ends: long>>", "append", GroupStateTimeout.NoTimeout)
