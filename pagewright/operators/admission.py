"""Admission: rate limit, budget ledger and the order of gates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright import limits


def rate_limit(events: DataFrame, limit: int = limits.RATE_LIMIT, period: str = f"{limits.RATE_PERIOD_SECONDS} seconds") -> DataFrame:
    """[I9] Adds window_start and limited to events (ts, client, event_id): beyond the first ``limit`` of a client in a tumbling window. Without a client nothing is limited."""
    alone = F.when(F.col("client").isNull(), F.col("event_id"))  # so that events without a client are no group
    w = Window.partitionBy("client", "window_start", alone).orderBy("ts", "event_id")
    timed = events.withColumn("window_start", F.window("ts", period)["start"])
    return timed.withColumn("limited", (F.row_number().over(w) > limit) & F.col("client").isNotNull())


@dataclass
class Budget:
    """[I10-I12] Live reservations: id -> (tokens, requests, expires at ms)."""

    tokens: int = limits.BUDGET_INPUT_TOKENS
    requests: int = limits.BUDGET_REQUESTS
    deadline_ms: int = limits.SEARCH_DEADLINE_MS
    live: dict[str, tuple[float, int, int]] = field(default_factory=dict)

    def reserve(self, name: str, tokens: float, requests: int, now: int) -> int | None:
        """Null if admitted, else the seconds to wait: until the next reservation ends, at least 1, at most the deadline."""
        self.live = {k: v for k, v in self.live.items() if v[2] > now}
        held = sum(v[0] for v in self.live.values()), sum(v[1] for v in self.live.values())
        if held[0] + tokens <= self.tokens and held[1] + requests <= self.requests:
            self.live[name] = tokens, requests, now + self.deadline_ms
            return None
        wait = min((v[2] for v in self.live.values()), default=now + self.deadline_ms) - now
        return min(max(1, -(-wait // 1000)), -(-self.deadline_ms // 1000))

    def release(self, name: str) -> None:
        self.live.pop(name, None)


LEDGER = "budget string, event_id long, admitted boolean, wait_seconds int, live int, held_tokens double"


def budget_ledger(events: DataFrame, tokens: int = limits.BUDGET_INPUT_TOKENS, requests: int = limits.BUDGET_REQUESTS, deadline_ms: int = limits.SEARCH_DEADLINE_MS) -> DataFrame:
    """[I10-I13] The outcome of each reserve event (budget, event_id, ts, action, name, tokens, requests), in time order per budget.

    A budget is one sequential ledger, so it is one group; rows of the group arrive in sorted batches and only live reservations are held.
    """
    import pandas as pd

    def run(frames):
        key, ledger = None, None
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if r.budget != key:
                    key, ledger = r.budget, Budget(tokens, requests, deadline_ms)
                if r.action == "release":
                    ledger.release(r.name)
                    continue
                wait = ledger.reserve(r.name, r.tokens, r.requests, r.at)
                rows.append((key, r.event_id, wait is None, wait, len(ledger.live), sum(v[0] for v in ledger.live.values())))
            out = pd.DataFrame(rows, columns=["budget", "event_id", "admitted", "wait_seconds", "live", "held_tokens"])
            yield out.astype({"wait_seconds": "Int32"})

    dealt = events.select("budget", "event_id", "action", "name", F.col("tokens").cast("double").alias("tokens"), "requests", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return dealt.repartition("budget").sortWithinPartitions("budget", "at", "event_id").mapInPandas(run, LEDGER)


def first_gate(**gates: Column) -> Column:
    """[I17] The error of the first gate that fails, in the order they are given; gates are true where they let pass."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in gates.items()])
