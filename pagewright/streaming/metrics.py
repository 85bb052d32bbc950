"""Counts of streaming queries, and nothing else of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming.listener import StreamingQueryListener


class Counts(StreamingQueryListener):
    """[A15] ``spark.streams.addListener(Counts(emit))``: for each micro-batch, ``emit`` gets a dict of the query's name and numbers: batch, rows read, rows that its state holds, rows dropped as too late, milliseconds.

    No text, query, error message, path or option of a source or sink is passed on; of an end only whether it was a failure.
    """

    def __init__(self, emit: Callable[[dict], None]):
        self.emit = emit

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        held, dropped = (sum(getattr(s, c) for s in p.stateOperators) for c in ("numRowsTotal", "numRowsDroppedByWatermark"))
        self.emit({"event": "batch", "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "held": held, "dropped": dropped, "ms": p.batchDuration})

    def onQueryTerminated(self, event) -> None:
        self.emit({"event": "end", "failed": event.exception is not None})
