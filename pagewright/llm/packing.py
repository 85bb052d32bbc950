"""Best-fit packing of tokenized documents into sequences, by sweeps over run-length encoded sorted lists.

Documents become runs of token ids, longer ones are cut into pieces, and pieces are range-sorted by
length. From the longest length down, the pieces of a length meet the
open sequences' gaps, also sorted by length: a sweep gives each piece the successor gap (the
smallest that holds it), conflicts are resolved by rank (the piece of rank r takes the r-th such
gap), gaps are updated, and the sweep repeats until its pieces are placed; what no gap holds
opens new sequences. That is best-fit decreasing.

Lengths are whole numbers up to the capacity, so both sorted lists are kept run-length encoded: a run
of equal pieces is (length, ranks), a run of equal gaps is (gap, sequence numbers). Neither list has more
runs than there are lengths plus the splits that runs suffer, however many documents there are: about
ten thousand for 10^5 documents as for 10^11. The sweeps are therefore one loop on the driver and not jobs of their own; the README has
its figures. Everything that follows the number of documents -
tokenizing, the range sort, ranks, and giving each piece its sequence and offset - is distributed.
"""

from __future__ import annotations

import re
import struct
import sys
import unicodedata
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded, materialize

CAPACITY = 2048
END_ID = 0
#: Distinct pre-tokens whose ids a worker remembers; longer ones than these characters it doesn't.
CACHE_ENTRIES = 400_000
CACHE_CHARACTERS = 64

#: The pre-tokens of byte-level BPE for texts without the characters below. Python's classes of letters
#: and digits differ from the tokenizer's for numbers that aren't decimal digits and for four controls.
_PRE_TOKENS = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Unknown(Exception):
    """The fast cut may differ from the tokenizer's own."""


class _Remembered(dict):
    """What ``make`` gives, by its argument. Half of what may be remembered is the older half, which is forgotten when the newer one is full, but for what was asked for again."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > CACHE_CHARACTERS:
                return value
        if len(self) >= CACHE_ENTRIES // 2:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Little-endian 32-bit ids of texts, by the ``tokenizers`` file at ``path``.

    Texts are cut into pre-tokens, whose ids are remembered. Pre-tokens with characters for which the
    fast cut may differ from the tokenizer's own send the whole text to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        others = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.odd = frozenset("\x1c\x1d\x1e\x1f").union(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl", "Cs"))
        self.known = _Remembered(self._of)

    def _of(self, pre_token: str) -> bytes:
        if not self.odd.isdisjoint(pre_token):
            raise _Unknown
        mapped = pre_token.encode().decode("latin-1").translate(self.letters)
        return _little([t.id for t in self.model.tokenize(mapped)])

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._slow(text)
        try:
            return b"".join(map(self.known.__getitem__, _PRE_TOKENS.findall(text)))
        except _Unknown:
            return self._slow(text)

    def _slow(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return _little(ids)


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """This process's encoder: what one task remembers, the next one knows."""
    return Encoder(path)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *[(at, capacity) for at in range(first, length, capacity)]]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids, then ``end_id``, cut at ``capacity``. One pass."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in bounded(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(encoder.encode(text or "") + end)
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): runs of pieces and where they go, for ``counts`` pieces by length.

    The pieces of a run have consecutive ranks within their length and go to consecutive sequences,
    all at the same offset.
    """
    gaps: list[int] = []  # sorted lengths of gaps
    open_runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, how many)
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def place(gap: int, first: int, n: int) -> None:
            out.append((length, rank, n, first, capacity - gap))
            rest = gap - length
            if rest:
                if rest not in open_runs:
                    insort(gaps, rest)
                open_runs.setdefault(rest, []).append((first, n))

        while left:
            at = bisect_left(gaps, length)  # the successor gap
            if at < len(gaps):
                gap = gaps[at]
                first, n = open_runs[gap].pop()
                if n > left:
                    open_runs[gap].append((first + left, n - left))
                    n = left
                if not open_runs[gap]:
                    del open_runs[gap], gaps[at]
            else:  # as many new sequences as what is left fills with pieces of this length
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            place(gap, first, n)
            rank, left = rank + n, left - n
    return out


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32); ``cut_pieces`` should be a stored table.

    Pieces are range-sorted by length, longest first, then doc_id and piece; one length may span any
    number of partitions. A stored partition and row number stands for each piece's place; the
    counts by partition and length (at most partitions + lengths rows, as the table is sorted) give each
    partition's first rank in each length. The runs that ``sweep`` places are cut at those
    borders and sent to the workers, which look up their pieces by place.
    """
    import numpy as np
    import pyarrow as pa

    spark = cut_pieces.sparkSession
    order = [F.desc("length"), F.col("doc_id"), F.col("piece")]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_pieces.repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # partition above, row within it below
    stored = materialize(ranged.select(*cut_pieces.columns, place.alias("place")), "packing-sorted")
    part = F.shiftright("place", 33)
    runs = stored.groupBy(part.alias("part"), "length").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("part", "length").collect()
    counts: dict[int, int] = {}
    begun: list[tuple[int, int, int, int]] = []  # length, first rank, ranks, first place
    for r in runs:
        begun.append((r["length"], counts.get(r["length"], 0), r["n"], r["first"]))
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    placed: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, rank, k, first, offset in sweep(counts, capacity):
        placed.setdefault(length, []).append((rank, k, first, offset))
    rows = []
    for length, rank, k, at in begun:
        own = placed[length]
        i = max(0, bisect_left(own, (rank + 1,)) - 1)
        while i < len(own) and own[i][0] < rank + k:
            lo, hi = max(rank, own[i][0]), min(rank + k, own[i][0] + own[i][1])
            rows.append((at + lo - rank, own[i][2] + lo - own[i][0], own[i][3]))
            i += 1
    rows.sort()
    table = spark.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 3))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        lookup = table.value
        for batch in bounded(batches, 10_000):
            places = batch.column(5).to_numpy(zero_copy_only=False)
            i = np.searchsorted(lookup[:, 0], places, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(lookup[i, 1] + places - lookup[i, 0]), pa.array(lookup[i, 2])], [*columns, "sequence_id", "offset"])

    return stored.select(*columns, "place").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, text; other columns are ignored).

    A null text is empty and gives one piece, the end id alone. Null doc_ids are kept; repeated rows
    are packed as often as they come, and which of them gets which place among equals is settled
    by the stored sort. An empty table gives no rows.
    """
    return pack(materialize(pieces(docs, tokenizer, capacity, end_id), "packing-pieces"), capacity)
