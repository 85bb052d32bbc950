"""Results that a newer search has overtaken, on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How long a search may take, and how late its rows may come.
WITHIN = "15 seconds"
LATENESS = "1 minute"


def overtaken(results: DataFrame, requests: DataFrame, within: str = WITHIN, lateness: str = LATENESS) -> DataFrame:
    """[I5] ``results`` (document_id, request_id, started_at, at, ...) with ``overtaken_by``: a request for the same document that began after the result's own and before the result came, or null for a result that still counts.

    ``started_at`` is when the result's request began, ``at`` when the result came, ``requests`` (document_id, request_id, started_at) are those of all searches. A result that several requests have overtaken comes once for each.
    Both sides wait for each other as long as ``within`` and ``lateness`` allow, and are then forgotten: a result is given out as counting when no request can overtake it any more. Rows later than that are dropped, and
    counted in the query's progress (``metrics.Counts`` tells them). Requests of one moment are in the order of their ids. On tables the same join has no such bounds to wait for.
    """
    own = results.withWatermark("at", lateness)
    newer = requests.select(F.col("document_id").alias("__document"), F.col("request_id").alias("overtaken_by"), F.col("started_at").alias("__began")).withWatermark("__began", lateness)
    later = (F.col("__began") > F.col("started_at")) | ((F.col("__began") == F.col("started_at")) & (F.col("overtaken_by") > F.col("request_id")))
    later &= F.col("overtaken_by") != F.col("request_id")
    bounds = (F.col("__began") <= F.col("at")) & (F.col("__began") >= F.col("at") - F.expr(f"interval {within}"))
    return own.join(newer, (F.col("document_id") == F.col("__document")) & later & bounds, "left_outer").drop("__document", "__began")
