"""A sink of message lines that takes each micro-batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def write_batch(path: str, query: str) -> Callable[[DataFrame, int], None]:
    """[A10] For ``foreachBatch``: writes a micro-batch's messages, one JSON line each, absent fields left out, as the folder of this query and batch.

    A batch that is run again, after a failure or from a checkpoint, replaces its folder with the same lines, so none is there twice; a batch that failed half-way has left none. ``read_messages`` reads the folders of all queries.
    """

    def write(messages: DataFrame, batch: int) -> None:
        line = F.to_json(F.struct(*messages.columns), {"ignoreNullFields": "true"})
        messages.select(line.alias("value")).write.mode("overwrite").text(f"{path}/query={query}/batch={batch}")

    return write


def message_sink(messages: DataFrame, path: str, query: str, checkpoint: str) -> DataStreamWriter:
    """[A10] A stream writer of ``messages`` to ``path``, to be started with a trigger. ``query`` must stay the same, as must ``checkpoint``, for as long as the lines are to be whole."""
    return messages.writeStream.queryName(query).option("checkpointLocation", checkpoint).foreachBatch(write_batch(path, query))
