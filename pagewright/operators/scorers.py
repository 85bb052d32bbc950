"""Scorers: what judges passages is pluggable."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import limits
from pagewright.operators.validate import is_valid_answer


class Scorer(Protocol):
    def score(self, batches: DataFrame) -> DataFrame:
        """Answers (document_id, request_id, segment_id, score, confidence, probabilities) of batch rows."""


class ReplayScorer:
    """Answers from a table; for tests and for runs that must be repeatable."""

    def __init__(self, answers: DataFrame):
        self.answers = answers

    def score(self, batches: DataFrame) -> DataFrame:
        asked = batches.where("evaluated").select("document_id", "request_id", F.col("id").alias("segment_id")).distinct()
        return self.answers.join(asked, ["document_id", "request_id", "segment_id"], "left_semi")


class TermScorer:
    """A stand-in that counts which words of the query a passage holds. Its output says nothing about search quality."""

    def score(self, batches: DataFrame) -> DataFrame:
        rows = batches.where("evaluated")
        share = term_share(F.col("text"), F.col("query"))
        rest = F.round(1 - share, 2)
        levels = F.create_map(F.lit("0"), F.round(rest / 2, 3), F.lit("1"), F.round(rest / 2, 3), F.lit("2"), share)
        return rows.select("document_id", "request_id", F.col("id").alias("segment_id"), F.round(2 * share + rest / 2, 3).alias("score"), F.lit(0.5).alias("confidence"), levels.alias("probabilities"))


def term_share(text, query):
    """The share of the query's distinct lower-case words that a text contains, to two decimals."""
    terms = F.array_distinct(F.filter(F.split(F.lower(query), " "), lambda t: t != ""))
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t)))
    return F.round(F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(0.0), 2)


def parse_retry_after(header: str | None, now_ms: float) -> float | None:
    """[H29] for the connector: milliseconds, or null for a header that is neither seconds nor a date."""
    from email.utils import parsedate_to_datetime

    if header is None:
        return None
    try:
        seconds = float(header.strip() or 0)
        if 0 <= seconds < float("inf"):
            return seconds * 1000
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() * 1000 - now_ms)
    except (TypeError, ValueError):
        return None


def call_once_more(send: Callable, body: str, deadline_ms: float, clock: Callable[[], float] = lambda: time.time() * 1000, sleep: Callable[[float], None] = lambda ms: time.sleep(ms / 1000)) -> tuple[str | None, str | None]:
    """[I6, I7] (reply, error code) of one request: a retryable status is tried once more, if the wait ends before the deadline, a lost connection at once."""
    for attempt in (0, 1):
        left = deadline_ms - clock()
        if left <= 0:
            return None, "provider_timeout"
        wait = limits.RETRY_DELAY_MS
        try:
            status, headers, reply = send(body, left)
            if status == 200:
                return reply, None
            if status not in limits.RETRYABLE_STATUS:
                return None, "provider_unavailable"
            asked = parse_retry_after(headers.get("retry-after"), clock())
            wait = limits.RETRY_DELAY_MS if asked is None else asked
        except TimeoutError:
            return None, "provider_timeout"
        except OSError:
            wait = 0
        if attempt or clock() + wait >= deadline_ms:
            return None, "provider_unavailable" if attempt else "provider_timeout"
        sleep(wait)
    return None, "provider_unavailable"


def call_batches(bodies: DataFrame, send: Callable, concurrency: int = limits.MAX_CONCURRENT_REQUESTS, deadline_ms: float = limits.SEARCH_DEADLINE_MS, clock: Callable[[], float] = lambda: time.time() * 1000, sleep: Callable[[float], None] = lambda ms: time.sleep(ms / 1000)) -> DataFrame:
    """[A12, K12, I6] (document_id, request_id, batch_no, reply, error_code) of request bodies.

    A search, which is a (document_id, request_id), is one group of a partition: its batches are sent in order, at most ``concurrency`` at once, and share one deadline,
    ``deadline_ms`` after its first request; other searches have their own. ``send(body, timeout_ms) -> (status, headers, reply)`` runs on the workers. A failure is a row.
    """
    import pandas as pd

    keys = ["document_id", "request_id"]

    def run(frames):
        from concurrent.futures import ThreadPoolExecutor

        search, deadline = None, 0.0
        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for frame in frames:
                found = []
                at = 0
                names = list(zip(frame["document_id"], frame["request_id"]))
                while at < len(names):
                    upto = at + 1
                    while upto < len(names) and names[upto] == names[at]:
                        upto += 1
                    if names[at] != search:  # a search that fills several frames keeps its deadline
                        search, deadline = names[at], clock() + deadline_ms
                    found += pool.map(lambda body, until=deadline: call_once_more(send, body, until, clock, sleep), frame["body"].iloc[at:upto])
                    at = upto
                yield pd.DataFrame({"document_id": frame["document_id"], "request_id": frame["request_id"], "batch_no": frame["batch_no"], "reply": [f[0] for f in found], "error_code": [f[1] for f in found]})

    rows = bodies.select(*keys, "batch_no", F.to_json("body").alias("body")).repartition(*keys).sortWithinPartitions(*keys, "batch_no")
    return rows.mapInPandas(run, "document_id long, request_id string, batch_no int, reply string, error_code string")


def parse_replies(replies: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[K11, I8, D11, D13] (answers, outcomes) of replies; ``expected`` (document_id, request_id, batch_no, segment_id) is what was asked.

    ``outcomes`` has a row per request: error_code (any failed batch fails the request: its first code by batch), the summed usage, and the
    model of the last batch. Answers of failed requests are left out.
    """
    from pagewright.functions.text import segment_of_question

    answer = "struct<type: string, score: double, confidence: double, probabilities: map<string, double>>"
    shape = f"model string, usage struct<input_tokens: long, output_tokens: long>, answers map<string, {answer}>"
    parsed = replies.withColumn("r", F.from_json("reply", shape))
    rows = parsed.select("document_id", "request_id", "batch_no", F.explode_outer("r.answers").alias("key", "a")).where("key is not null")
    rows = rows.withColumn("segment_id", segment_of_question(F.col("key"))).withColumn("ok", is_valid_answer(F.col("a.type"), F.col("a.score"), F.col("a.confidence"), F.col("a.probabilities")) & F.col("segment_id").isNotNull())
    keys = ["document_id", "request_id", "batch_no"]
    asked = expected.select(*keys, "segment_id", F.lit(True).alias("asked"))
    met = rows.select(*keys, "segment_id", "a", "ok", F.lit(True).alias("came")).join(asked, [*keys, "segment_id"], "full_outer")
    sound = met.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("asked") & F.col("came") & F.col("ok"), F.lit(False))).alias("sound"))
    state = parsed.join(sound, keys, "left").withColumn("code", F.coalesce("error_code", F.when(~F.coalesce("sound", F.lit(False)), "provider_malformed_response")))
    outcomes = state.groupBy("document_id", "request_id").agg(
        F.min_by("code", F.when(F.col("code").isNotNull(), F.col("batch_no"))).alias("error_code"),
        F.coalesce(F.sum("r.usage.input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("r.usage.output_tokens"), F.lit(0)).alias("output_tokens"),
        F.max_by("r.model", F.when(F.col("r.model").isNotNull(), F.col("batch_no"))).alias("model"),
        F.count(F.lit(1)).alias("request_count"),
    )
    good = outcomes.where("error_code is null").select("document_id", "request_id")
    answers = met.where("came and asked").select("document_id", "request_id", "segment_id", "a.score", "a.confidence", "a.probabilities").join(good, ["document_id", "request_id"], "left_semi")
    return answers, outcomes
