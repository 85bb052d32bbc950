"""Progress streams of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright import limits
from pagewright.operators.validate import are_valid_records, is_error_reply

SEARCH = ["document_id", "request_id"]


def shape_error(sent: str = "sent", total: str = "expected_total"):
    """[I3] Whether one message is malformed in itself, whatever came before it. ``sent`` is a column of the ids that were sent."""
    progress = F.col("evaluated").isNotNull() & (F.col("total") == F.col(total)) & F.col("evaluated").between(0, F.col(total)) & are_valid_records(F.col("results"), F.col(sent))
    final = (
        F.col("status").isin("matched", "uncertain", "no_match")
        & F.col("model").isNotNull()
        & (F.col("elapsed_ms") >= 0)
        & (F.col("elapsed_ms") < float("inf"))
        & (F.col("request_count") >= 0)
        & (F.col("evaluated_segment_count") == F.col(total))
        & are_valid_records(F.col("results"), F.col(sent))
        & (F.col("evaluations").isNull() | are_valid_records(F.col("evaluations"), F.col(sent)))
    )
    sound = F.when(F.col("type") == "progress", progress).when(F.col("type") == "final", final).when(F.col("type") == "error", is_error_reply(F.col("error")))
    return ~F.coalesce(sound, F.lit(False))


def validate_batch(messages: DataFrame) -> DataFrame:
    """[I3, E11] Adds ok to messages (seq, document_id, request_id, …, sent, expected_total): the batch twin of ``validate_stream``.

    Counts of good progress messages never fall, and nothing follows a good terminal message. A malformed message changes nothing.
    """
    w = Window.partitionBy(*SEARCH).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shaped = messages.withColumn("__bad", shape_error())
    ended = F.coalesce(F.max(F.when(~F.col("__bad") & F.col("type").isin("final", "error"), 1)).over(w), F.lit(0)) == 1
    # a progress message below the highest count so far is refused, and can't raise it, so the running maximum of all well-formed ones is that of the accepted ones
    seen = F.coalesce(F.max(F.when(~F.col("__bad") & (F.col("type") == "progress"), F.col("evaluated"))).over(w), F.lit(0))
    falls = (F.col("type") == "progress") & (F.col("evaluated") < seen)
    return shaped.withColumn("ok", ~F.col("__bad") & ~ended & ~F.coalesce(falls, F.lit(False))).drop("__bad")


def search_outcomes(messages: DataFrame) -> DataFrame:
    """[I2, I4] (document_id, request_id, kind, error_code): the one outcome of each search whose messages (as ``validate_batch`` takes them) came: its first good terminal message.

    A malformed message before it ends the search as ``provider_malformed_response``, as does a body without a terminal message; what comes after the outcome changes nothing.
    """
    told = validate_batch(messages)
    stops = F.when(~F.col("ok") | F.col("type").isin("final", "error"), F.struct("seq", "ok", "type", F.col("error.code").alias("code")))
    first = told.groupBy(*SEARCH).agg(F.min(stops).alias("m"))
    good = F.coalesce(F.col("m.ok"), F.lit(False))
    return first.select(*SEARCH, F.when(good & (F.col("m.type") == "final"), "final").otherwise("error").alias("kind"), F.when(~good, "provider_malformed_response").when(F.col("m.type") == "error", F.col("m.code")).alias("error_code"))


def _search_state():
    from pyspark.sql.streaming.state import GroupStateTimeout

    return GroupStateTimeout


def validate_stream(messages: DataFrame) -> DataFrame:
    """[I2, I3] (document_id, request_id, seq, type, ok) of a stream of messages with sent and expected_total; state per search: the highest count and whether it has ended."""
    import pandas as pd

    def run(key, frames, state):
        seen, ended = state.get if state.exists else (0, False)
        for frame in frames:
            frame = frame.sort_values("seq")
            oks = []
            for r in frame.itertuples(index=False):
                ok = not r.bad and not ended and not (r.type == "progress" and r.evaluated < seen)
                if ok and r.type == "progress":
                    seen = int(r.evaluated)
                ended = ended or ok and r.type in ("final", "error")
                oks.append(bool(ok))
            yield pd.DataFrame({"document_id": key[0], "request_id": key[1], "seq": frame["seq"], "type": frame["type"], "ok": oks})
        state.update((int(seen), bool(ended)))

    rows = messages.withColumn("bad", shape_error()).select(*SEARCH, "seq", "type", "evaluated", "bad")
    return rows.groupBy(*SEARCH).applyInPandasWithState(run, "document_id string, request_id string, seq long, type string, ok boolean", "seen int, ended boolean", "append", _search_state().NoTimeout)


OUTPUT = "document_id long, request_id string, type string, evaluated int, total int, results array<string>, status string, error_code string"


def progress_stream(answers: DataFrame, deadline_ms: int = limits.SEARCH_DEADLINE_MS, most: int = limits.MAX_RESULTS) -> DataFrame:
    """[I1, I2, I6] Progress and one terminal message of each search, from a stream of answers.

    ``answers``: document_id, request_id, total, segment_id, doc_ordinal, score, relevant_probability, error_code. Progress has the best passages so far and no
    verdict; it becomes final once all passages are judged, error at the first error_code, and error (provider_timeout) if the deadline after a search's
    first answer passes. After the terminal message a search is silent.
    """
    import pandas as pd

    timeouts = _search_state()

    def best(rows):
        ranked = sorted((r for r in rows if r[2] >= limits.MATCHED), key=lambda r: (-r[2], -r[1], r[3]))
        return [r[0] for r in ranked[:most]]

    def status(rows):
        top = max((r[2] for r in rows), default=0.0)
        return "matched" if top >= limits.MATCHED else "uncertain" if top >= limits.UNCERTAIN else "no_match"

    def message(key, kind, n, total, results, verdict, code):
        return pd.DataFrame({"document_id": [key[0]], "request_id": [key[1]], "type": [kind], "evaluated": pd.array([n], "Int32"), "total": pd.array([total], "Int32"), "results": [results], "status": [verdict], "error_code": [code]})

    def run(key, frames, state):
        if state.hasTimedOut:
            n, total, ended, _ = state.get
            state.update((n, total, True, []))
            if not ended:
                yield message(key, "error", n, total, None, None, "provider_timeout")
            return
        first = not state.exists
        n, total, ended, kept = (0, 0, False, []) if first else state.get
        rows = [tuple(r) for r in kept]
        code = None
        for frame in frames:
            for r in frame.itertuples(index=False):
                total = int(r.total)
                if isinstance(r.error_code, str):
                    code = code or r.error_code
                else:
                    rows.append((r.segment_id, float(r.score), float(r.relevant_probability), int(r.doc_ordinal)))
                    n += 1
        if ended:
            return
        top = max(rows, key=lambda r: r[2], default=None)
        shown = best(rows)
        keep = [r for r in rows if r[0] in shown] or ([top] if top else [])  # all that later verdicts and ranks need
        done = code is not None or n >= total
        state.update((n, total, done, keep))
        if code is not None:
            yield message(key, "error", n, total, None, None, code)
        elif done:
            yield message(key, "final", n, total, shown, status(rows), None)
        else:
            if first:
                state.setTimeoutDuration(deadline_ms)
            yield message(key, "progress", n, total, shown, None, None)

    state = "n int, total int, ended boolean, kept array<struct<id: string, score: double, p: double, at: int>>"
    return answers.groupBy(*SEARCH).applyInPandasWithState(run, OUTPUT, state, "append", timeouts.ProcessingTimeTimeout)


def latest_requests(requests: DataFrame) -> DataFrame:
    """[I5] The newest request of each document; results of any other are stale, by identity and not by time."""
    return requests.groupBy("document_id").agg(F.max_by("request_id", F.struct("started_at", "request_id")).alias("request_id"))


def drop_stale(results: DataFrame, requests: DataFrame) -> DataFrame:
    """[I5] Results of requests that are still their document's newest."""
    return results.join(latest_requests(requests), SEARCH, "left_semi")

