"""Message lines from the chunks of response bodies.

A search's body arrives in chunks that end anywhere, also inside a line or a character. Chunks say where they begin, so what comes twice is dropped and what comes early waits.
The bytes behind the last line feed are carried on; the end of the body ends the last line too. A line over the character limit, finished or not, ends its search with an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import limits, schemas

SEARCH = ["document_id", "request_id"]
LINES = "document_id string, request_id string, line_no long, line string, error_code string"
CHUNKS = "document_id string, request_id string, begin long, bytes binary, last boolean"
#: The error of a body that can't be read on. Fixed value.
MALFORMED = "provider_malformed_response"


_CONTINUED = bytes(range(0x80, 0xC0))


def _characters(data: bytes) -> int:
    """Characters that begin in ``data``: bytes that don't continue one."""
    return len(data.translate(None, _CONTINUED))


class Framer:
    """One search's body: the bytes of its unfinished line, where the next chunk begins, lines so far, whether it has ended, and chunks that came early."""

    def __init__(self, most: int, tail: bytes = b"", at: int = 0, lines: int = 0, ended: bool = False, early: tuple = ()):
        self.most, self.tail, self.at, self.lines, self.ended, self.early = most, bytearray(tail), at, lines, ended, list(early)
        self.begun = _characters(tail)  # characters of the unfinished line

    def state(self) -> tuple:
        return bytes(self.tail), self.at, self.lines, self.ended, [tuple(x) for x in self.early]

    def feed(self, begin: int, data: bytes, last: bool):
        """(line_no, line, error_code) of the lines that this chunk, and early ones that follow it, finish."""
        if self.ended:
            return
        self.early.append((begin, data, last))
        if begin <= self.at:
            self.early.sort()
            while self.early and self.early[0][0] <= self.at and not self.ended:
                begin, data, last = self.early.pop(0)
                fresh = data[self.at - begin :] if begin + len(data) > self.at else b""
                whole = begin + len(data) == self.at + len(fresh)
                self.at += len(fresh)
                yield from self._take(fresh, last and whole)
        if not self.ended and sum(len(x[1]) for x in self.early) > 4 * self.most:  # what is missing may never come
            yield self._fail()

    def _fail(self) -> tuple:
        self.tail, self.ended, self.early = bytearray(), True, []
        self.lines += 1
        return self.lines - 1, None, MALFORMED

    def _take(self, data: bytes, last: bool):
        *whole, rest = data.split(b"\n")
        for part in whole + [rest] * last:
            text = bytes(self.tail + part).decode("utf-8", "replace")
            self.tail, self.begun = bytearray(), 0
            if len(text) > self.most:
                yield self._fail()
                return
            if text.strip():
                self.lines += 1
                yield self.lines - 1, text, None
        if last:
            self.ended, self.early = True, []
            return
        self.tail += rest
        self.begun += _characters(rest)
        if self.begun > self.most:
            yield self._fail()


def frame_chunks(chunks: DataFrame, most: int = limits.STREAM_BUFFER_CHARACTERS) -> DataFrame:
    """[A11, I4] (document_id, request_id, line_no, line, error_code) of whole bodies in chunks (document_id, request_id, begin, bytes, last).

    One shuffle by search; a search's chunks pass by in order, one at a time. Blank lines are no lines. A body without a last chunk keeps its unfinished line to itself; a gap is never bridged.
    Null bytes are none, repeated and overlapping chunks count once.
    """
    import pyarrow as pa

    rows = chunks.select(*[F.col(c).cast("string").alias(c) for c in SEARCH], "begin", F.coalesce("bytes", F.lit(b"")).alias("bytes"), F.coalesce("last", F.lit(False)).alias("last"))
    dealt = rows.repartition(*SEARCH).sortWithinPartitions(*SEARCH, "begin", "last")

    def run(batches):
        key, framer = None, None
        for batch in batches:
            out = []
            for document, request, begin, data, last in zip(*(c.to_pylist() for c in batch.columns)):
                if key is None or key != (document, request):
                    key, framer = (document, request), Framer(most)
                out += [(document, request, *line) for line in framer.feed(begin, data, last)]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))], ["document_id", "request_id", "line_no", "line", "error_code"])

    return dealt.mapInArrow(run, LINES)


def frame_stream(chunks: DataFrame, most: int = limits.STREAM_BUFFER_CHARACTERS) -> DataFrame:
    """[A11, I4] ``frame_chunks`` on a stream: the state of a search is what its framer holds, at most a line and what came early."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, frames, state):
        framer = Framer(most, *state.get) if state.exists else Framer(most)
        rows = []
        for begin, data, last in sorted((int(r.begin), bytes(r.bytes), bool(r.last)) for f in frames for r in f.itertuples(index=False)):
            rows += [(*key, *line) for line in framer.feed(begin, data, last)]
        state.update(framer.state())
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in LINES.split(", ")]).astype({"line_no": "int64"})

    kept = "tail binary, at long, lines long, ended boolean, early array<struct<begin: long, bytes: binary, last: boolean>>"
    rows = chunks.select(*[F.col(c).cast("string").alias(c) for c in SEARCH], "begin", F.coalesce("bytes", F.lit(b"")).alias("bytes"), F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy(*SEARCH).applyInPandasWithState(run, LINES, kept, "append", GroupStateTimeout.NoTimeout)


def messages_of(lines: DataFrame) -> DataFrame:
    """The messages of lines, by SURVEY's message schema, with line_no as seq; ``malformed`` is true for a line that is none, and for what ended a search."""
    parsed = lines.select("line_no", "error_code", F.from_json("line", schemas.MESSAGE).alias("m"))
    return parsed.select(F.col("line_no").alias("seq"), "m.*", (F.col("m.type").isNull() | F.col("error_code").isNotNull()).alias("malformed"))
