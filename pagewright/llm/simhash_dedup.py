"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints link at ``distance`` or fewer differing bits. Cut into ``distance // 2 + 1`` segments,
two linked fingerprints have at least one segment in which they differ by one bit at most (else
they would differ by twice as many bits as there are segments). Each segment is indexed under all
its one-wildcard variants: the wildcard's place and the segment with that bit cleared. Segments that
differ by one bit at most share such a variant, so an equality join on variants finds every link,
and the XOR of the whole fingerprints verifies it. A pair is emitted only at the first of the
variants it shares.

Copies are collapsed first: only distinct fingerprints are indexed, so a group of equal texts costs
as much as one text however large it is.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded, connected_components, discard, materialize, salted_join

SEED = 42
BITS = 64
#: Ids with digests that may be sent to all tasks, about 10 MB.
BROADCAST_ROWS = 150_000
_BLOCK = 1 << 16  # shingles whose bits are held at once


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text.

    A-Z are lower-cased; shingles are runs of ``words`` words, joined by single spaces, repeats
    included. A text of fewer words is one shingle, a text of none has fingerprint 0. A bit is 1
    if over half of the shingles' XXH64 hashes have it.
    """
    import numpy as np
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return 0
    whole, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) < words:
        return digest(whole, SEED)
    ends = list(accumulate(map(len, found), lambda end, n: end + n + 1))
    starts = [0, *[end + 1 for end in ends[:-words]]]
    ends = ends[words - 1 :]
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(ends), _BLOCK):
        hashes = [digest(whole[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp, tid): the fingerprint as a signed long and a 128-bit digest of the text. One pass, no shuffle; null texts are empty."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for batch in bounded(batches):
            values = [fingerprint(text.as_py(), words) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64)), batch.column(2)], ["doc_id", "fp", "tid"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_key()).mapInArrow(run, "doc_id long, fp long, tid string")


def _text_key():
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments that ``distance`` differing bits ask for."""
    n = distance // 2 + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b), a < b: every pair of distinct fingerprints of ``prints`` (column fp) that differ in 1 to ``distance`` bits, once."""
    cut = segments(distance)
    variants = [
        F.struct(F.lit(k * BITS + bit).alias("place"), F.col("fp").bitwiseAND(_signed(((1 << width) - 1 << low) & ~(1 << low + bit))).alias("rest"))
        for k, (low, width) in enumerate(cut)
        for bit in range(width)
    ]
    index = prints.select("fp", F.explode(F.array(*variants)).alias("v")).select("fp", "v.place", "v.rest")
    # each fingerprint has a row per bit: the sizes of the stored fingerprints say nothing about the index, so no broadcast
    x, y = index.alias("x").hint("merge"), index.alias("y")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    within = [differ.bitwiseAND(_signed((1 << width) - 1 << low)) for low, width in cut]
    first = F.lit(False)
    for k, (low, width) in enumerate(cut):  # the first segment that differs by one bit at most, at that bit or at its lowest
        here = (F.col("x.place") >= k * BITS) & (F.col("x.place") < (k + 1) * BITS)
        for before in range(k):
            here &= F.bit_count(within[before]) > 1
        bit = F.expr(f"shiftleft(1L, cast(x.place - {k * BITS - low} as int))")
        first |= here & ((within[k] == bit) | ((within[k] == 0) & (F.col("x.place") == k * BITS)))
    return x.join(y, (F.col("x.place") == F.col("y.place")) & (F.col("x.rest") == F.col("y.rest")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(differ) <= distance) & first).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def _signed(mask: int):
    mask &= (1 << 64) - 1
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id, tid) of every row of ``docs`` (doc_id, text; other columns are ignored).

    ``component_id`` is the smallest doc_id that chains of links reach, itself included. Null and
    empty texts share fingerprint 0 and so one component. A null doc_id takes part, but names no
    component unless it has no other; repeated rows are returned as often as they come; an empty
    table gives no rows. Texts of any length are read whole, their shingles _BLOCK at a time.
    """
    return components(materialize(fingerprints(docs, words), "simhash"), distance)


def components(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id, tid) of a stored table of fingerprints (doc_id, fp, tid)."""
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-groups")
    found = materialize(links(groups.select("fp"), distance), "simhash-links")
    roots = materialize(connected_components(found, "simhash-components"), "simhash-roots")
    members = groups.join(roots, groups.fp == roots.node, "left").select("fp", "first", "n", "root")
    linked = members.where("root is not null")
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    shared = salted_join(linked.select("fp", "root"), lowest, ["root"], ["fp"], how="inner").select("fp", "component_id").union(members.where("root is null and n > 1").select("fp", F.col("first").alias("component_id")))
    shared = materialize(shared, "simhash-shared")
    discard(groups, found, roots)
    out = salted_join(prints, shared, ["fp"], ["doc_id"])
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"), "tid")


def keep_first(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """``docs``, all its columns, with one document of each component: that of the smallest doc_id.

    Rows that share this doc_id all stay, as do the rows of a component that has no doc_id at all: nothing
    tells which of them came first. Rows that go are named by doc_id and a 128-bit digest of their text; up to
    BROADCAST_ROWS of these are sent to the documents, beyond that both sides are shuffled. Columns may have any names.
    """
    found = materialize(near_duplicates(docs, words, distance), "simhash-components-of-rows")
    goes = found.where("component_id is not null and not (doc_id <=> component_id)")
    goes = materialize(goes.select("doc_id", "tid").distinct(), "simhash-gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("tid")).alias("d")
    small = (F.broadcast(goes) if goes.count() <= BROADCAST_ROWS else goes).alias("g")
    return rows.join(small, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.tid") == F.col("g.tid")), "left_anti").select("row.*")
