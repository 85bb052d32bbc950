"""Removal of repeated passages by a sparse suffix array.

Only suffixes that begin at minimisers are retained. Of every run of ``passage`` words, the anchor is
the place whose next ``gram`` words have the smallest hash; equal runs choose the same anchor wherever
they stand, so about one suffix in 20 meets every repeated passage. An anchor stands for the runs of ``passage`` words
that chose it; its reach is all words of these runs.

First sort: the retained suffixes are range-partitioned and sorted by their first ``gram`` words, then by a 128-bit digest of
their reach, then by place in the corpus. Neighbours are compared: a suffix whose first words no neighbour has is dropped, and one whose
whole reach equals that of an earlier document is a match for all of its runs. What is left goes into the second sort.

Second sort: suffixes with the words of their reach, to the right of the anchor in order and to the left backwards, are
range-partitioned and sorted by these words. Neighbours are compared word by word; the lengths of their common
prefixes (longest common prefix, LCP) say which suffixes share how many words to the right, and among these the match is
extended to the left on the words themselves. A run of ``passage`` words is a match where left and right extension reach it.

The first occurrence of a run (smallest doc_id, then place) stays, the others go. A text that is equal to
another document's needs no suffixes: all its words go if there are ``passage`` or more. No group of equal
suffixes is gathered: both sorts split a hot passage over as many partitions as it fills, a task compares ``segment``
suffixes at once, and what may go on beyond a segment's first or last suffix (the LCP tells) is settled by an aggregation of one row
for each run and segment.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import bounded, discard, materialize, salted_join

PASSAGE = 50
GRAM = 8
#: Suffixes of equal first words that a task compares at once.
SEGMENT = 16_384
#: First words longer than this are cut, and a digest of all of them put in the place of the rest.
MOST_PREFIX = 160
_M = 0x9E3779B97F4A7C15 | 1
_CACHE = 300_000
#: A doc_id that is null comes last among those of equal texts.
_NO_ID = (1 << 63) - 1


class _Hasher:
    """Hashes of runs of words over a list of texts laid end to end; they only choose anchors."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, texts: list[list[bytes]]):
        import numpy as np
        import xxhash

        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > _CACHE:
            known.clear()
        for own in texts:
            for w in set(own).difference(known):
                known[w] = digest(w)
        size = sum(map(len, texts))
        return np.fromiter((h for own in texts for h in map(known.__getitem__, own)), np.uint64, size)

    def runs(self, words, width: int):
        """The hash of the ``width`` words from each place, from hashes of the words."""
        import numpy as np

        n = max(0, len(words) - width + 1)
        out = np.zeros(n, np.uint64)
        for k in range(width if n else 0):
            out = out * np.uint64(_M) + words[k : k + n]
        for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            out ^= out >> np.uint64(shift)
            out *= np.uint64(by)
        return out ^ out >> np.uint64(33)


def _anchors(grams, window: int):
    """For each place, the first of the ``window`` places from there with the smallest gram hash."""
    import numpy as np

    best, at = grams.copy(), np.arange(len(grams))
    width = 1
    while width < window:
        step = min(width, window - width)
        a, b = best[:-step], best[step:]
        right = b < a
        best, at = np.where(right, b, a), np.where(right, at[step:], at[:-step])
        width += step
    return at


def _entries(texts, hasher: _Hasher, passage: int, gram: int):
    """(text number, place, first, last) of each anchor: ``first`` and ``last`` are the starts of the runs that chose it."""
    import numpy as np

    sizes = np.array([len(t) for t in texts], np.int64)
    grams = hasher.runs(hasher.words(texts), gram)
    owner = np.repeat(np.arange(len(texts)), sizes)
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    ends = len(owner) - passage + 1
    start = np.nonzero(owner[:ends] == owner[passage - 1 :])[0] if ends > 0 else np.zeros(0, np.int64)
    if not len(start):
        return start, start, start, start
    anchor = _anchors(grams, passage - gram + 1)[start]
    head = np.nonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[start][1:] != owner[start][:-1])]))[0]
    tail = np.concatenate([head[1:], [len(anchor)]]) - 1  # an anchor's runs are consecutive
    number = owner[start[head]]
    return number, *[x - begins[number] for x in (anchor[head], start[head], start[tail])]


def _laid(words: list[bytes]) -> tuple[bytes, list[int]]:
    """The words, each with a space behind it, and where each begins; the last place is the end."""
    whole = b" ".join(words) + b" "
    return whole, [0, *accumulate(len(w) + 1 for w in words)]


def _id(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(_NO_ID))


def suffixes(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """(did, tid, whole, n_words, entries array<struct<prefix, reach, place, first, last>>): each text's retained suffixes. One pass, no shuffle.

    ``did`` is the doc_id, null as the largest number; ``tid`` is a hash of the text that names it beside its ``did``, ``whole`` a 128-bit digest that tells equal texts. ``prefix`` is the suffix's first
    ``gram`` words, ``reach`` a digest of the words from ``first`` to ``last + passage`` and of the anchor's place among them.
    """
    import pyarrow as pa

    names = ["did", "tid", "whole", "n_words", "entries"]
    kinds = [("prefix", pa.binary()), ("reach", pa.binary()), ("place", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]

    def run(batches):
        import numpy as np
        import xxhash

        digest, hasher = xxhash.xxh3_128_digest, _Hasher()
        for batch in bounded(batches):
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in batch.column(3)]
            number, place, first, last = _entries(texts, hasher, passage, gram)
            cut = np.searchsorted(number, np.arange(len(texts) + 1)).astype(np.int32)
            prefixes, reaches = [], []
            for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                if a == b:
                    continue
                whole, at = _laid(texts[k])
                for p, f, e in zip(place[a:b].tolist(), first[a:b].tolist(), last[a:b].tolist()):
                    prefix = whole[at[p] : at[p + gram]]
                    prefixes.append(prefix if len(prefix) <= MOST_PREFIX else prefix[: MOST_PREFIX - 16] + digest(prefix))
                    reaches.append(digest(whole[at[f] : at[e + passage]], seed=p - f))
            values = [prefixes, reaches, place.astype(np.int32), first.astype(np.int32), last.astype(np.int32)]
            flat = pa.StructArray.from_arrays([pa.array(v, k) for v, (_, k) in zip(values, kinds)], [c for c, _ in kinds])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(cut), flat)], names)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    entry = "struct<prefix: binary, reach: binary, place: int, first: int, last: int>"
    return docs.select(_id(), F.xxhash64(text), F.unhex(F.md5(text.cast("binary"))), text).mapInArrow(run, f"did long, tid long, whole binary, n_words long, entries array<{entry}>")


def compare_neighbours(entries: DataFrame) -> DataFrame:
    """(did, tid, place, first, last, source) of suffixes (did, tid, prefix, reach, place, first, last) that share their first words with a neighbour.

    ``source`` is the doc_id of the first suffix of equal reach, if another text has it: all of the suffix's runs are
    matches. Where it is null, the suffix is to be extended. The first and the last group of a partition may go on in the next
    one, so their first suffixes are always among those.
    """
    import pyarrow as pa

    spark, order = entries.sparkSession, ["prefix", "reach", "did", "tid", "place"]
    columns = [*order, "first", "last"]
    names = ["did", "tid", "place", "first", "last", "source"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = entries.repartitionByRange(n, *order).select(*columns).sortWithinPartitions(*order)

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        def settled(table, begun, held_out, at_start, at_end):
            """Of rows that follow each other, the first of which is the owner of the class that goes on (if begun) and was put out before (if held_out)."""
            size = table.num_rows
            same = lambda c: np.concatenate([[False], pc.equal(table.column(c).slice(1), table.column(c).slice(0, size - 1)).to_numpy().astype(bool)])
            group_goes_on = same("prefix")
            class_goes_on = group_goes_on & same("reach")
            did, tid, place = (table.column(c).to_numpy() for c in ("did", "tid", "place"))
            owner = np.maximum.accumulate(np.where(class_goes_on, 0, np.arange(size)))
            group = np.cumsum(~group_goes_on) - 1
            heads = np.nonzero(~class_goes_on)[0]
            several = np.bincount(group[heads], minlength=group[-1] + 1) > 1
            at_border = np.zeros(len(several), bool)
            at_border[0] |= at_start
            at_border[-1] |= at_end
            own = class_goes_on & (did == did[owner]) & (tid == tid[owner])
            again = class_goes_on & own & (place == place[owner])  # a row that the table has twice
            same_row = np.concatenate([[False], (did[1:] == did[:-1]) & (tid[1:] == tid[:-1]) & (place[1:] == place[:-1])]) & class_goes_on
            inside = np.zeros(size, bool)
            inside[owner[own & ~again]] = True  # classes that one text has twice
            extend = (~class_goes_on & (several | at_border)[group]) | (~class_goes_on & inside) | (own & ~again)
            extend &= ~same_row
            matched = class_goes_on & ~own & ~same_row
            if begun:
                extend[0] &= not held_out
                matched[0] = False
            put = np.nonzero(extend | matched)[0]
            source = pa.array(did[owner[put]], pa.int64(), mask=extend[put])
            rows = table.take(pa.array(put))
            out = pa.table([*[rows.column(c) for c in names[:5]], source], names)
            head_put = bool(extend[owner[-1]] or begun and held_out and owner[-1] == 0)
            return out, int(owner[-1]), head_put

        held, held_out, first_group, start = None, False, None, True
        last = None
        for batch in bounded(batches, 10_000):
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if first_group is None:
                first_group = table.column("prefix")[0]
            begun = held is not None
            table = pa.concat_tables([held, table]).combine_chunks() if begun else table.combine_chunks()
            out, owner, put = settled(table, begun, held_out, start and table.column("prefix")[0] == first_group, False)
            start = start and table.column("prefix")[table.num_rows - 1] == first_group
            held, held_out = table.slice(owner, 1), put
            last = table.column("prefix")[table.num_rows - 1]
            if out.num_rows:
                yield from out.to_batches()
        if held is not None and not held_out:  # the owner of the last class: its group may go on in the next partition
            rows = pa.table([*[held.column(c) for c in names[:5]], pa.nulls(1, pa.int64())], names)
            yield from rows.to_batches()

    return ranged.mapInArrow(run, "did long, tid long, place int, first int, last int, source long")


def reaches(candidates: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """(right, left, least, most, did, tid, place) of ``candidates`` (did, tid, text, entries array<struct<place, first, last>>).

    ``right`` are the words from the anchor on, ``left`` those before it, the nearest first; ``least`` and ``most`` are how many words before
    the anchor its runs begin.
    """
    import pyarrow as pa

    schema = pa.schema([("right", pa.binary()), ("left", pa.binary()), ("least", pa.int32()), ("most", pa.int32()), ("did", pa.int64()), ("tid", pa.int64()), ("place", pa.int32())])

    def run(batches):
        for batch in bounded(batches):
            rows = []
            for did, tid, text, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                whole, at = _laid(words)
                for e in entries:
                    p, first, last = e["place"], e["first"], e["last"]
                    rows.append((whole[at[p] : at[last + passage]], b"".join([w + b" " for w in words[first:p][::-1]]), p - last, p - first, did, tid, p))
                if len(rows) > 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return candidates.select("did", "tid", "text", "entries").mapInArrow(run, "right binary, left binary, least int, most int, did long, tid long, place int")


def _shared(a: list[bytes], b: list[bytes]) -> int:
    """How many words two lists have in common from their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def settle(rows: list[tuple], passage: int, open_start: bool, open_end: bool):
    """Matches among sorted suffixes (right, left, least, most, did, tid, place) of equal first words.

    Yields (did, tid, place, runs, kept) for a suffix whose runs that begin ``runs`` (from, to) words before the anchor stand
    earlier, at the suffix ``kept`` (did, tid, place); and (did, tid, place, at, run) with a digest ``run`` for what may go on beyond the
    segment's open ends.
    """
    import xxhash

    n = len(rows)
    words = [r[0].split() for r in rows]
    common = [0, *[_shared(a, b) for a, b in zip(words, words[1:])], 0]
    from_start = list(accumulate(common[1:n], min, initial=passage)) if open_start else [-1] * n
    to_end = list(accumulate(reversed(common[1:n]), min, initial=passage))[::-1] if open_end else [-1] * n
    interval = [0] * (passage + 1)  # by words shared to the right, where the interval of suffixes that share them begins
    first: dict = {}
    runs = []
    for k, (right, left, least, most, did, tid, place) in enumerate(rows):
        interval[common[k] + 1 :] = [k] * (passage - common[k])
        longest = max(common[k], common[k + 1], from_start[k], to_end[k])
        least = max(least, passage - longest)
        if least > most:
            runs.append((least, ()))
            continue
        back = [0, *accumulate(len(w) + 1 for w in left.split())]
        keys = [(d, interval[passage - d], left[: back[d]]) for d in range(least, most + 1)]
        me = (did, tid, place)
        for key in keys:
            if (own := first.get(key)) is None or me < own:
                first[key] = me
        runs.append((least, keys))
    for k, (least, keys) in enumerate(runs):
        right, left, _, _, did, tid, place = rows[k]
        me, begun = (did, tid, place), None
        for key in keys:
            kept, d = first[key], key[0]
            reach = passage - d
            is_open = from_start[k] >= reach or to_end[k] >= reach
            if is_open and kept[:2] == me[:2]:
                ahead = [0, *accumulate(len(w) + 1 for w in words[k][:reach])]
                yield did, tid, place, place - d, xxhash.xxh3_128_digest(key[2] + b"\n" + right[: ahead[reach]])
                kept = me
            if begun and (kept != begun[2] or d != begun[1] + 1):
                yield did, tid, place, begun[:2], begun[2]
                begun = None
            if kept != me:
                begun = (begun[0] if begun else d, d, kept)
        if begun:
            yield did, tid, place, begun[:2], begun[2]


def extend_matches(reached: DataFrame, passage: int = PASSAGE, gram: int = GRAM, segment: int = SEGMENT) -> DataFrame:
    """(did, tid, from, to, stays_from, stays_to, source, run, at): matches among suffixes with their reaches.

    Words ``from`` to ``to`` go, as ``source`` has them, or as the text itself has them earlier, from ``stays_from``
    to ``stays_to``. Rows with ``run`` are occurrences, at ``at``, of runs that more than one segment may have.
    """
    import pyarrow as pa

    spark, order = reached.sparkSession, ["right", "left", "did", "tid", "place"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["right", "left", "least", "most", "did", "tid", "place"]
    ranged = reached.repartitionByRange(n, *order).select(*columns).sortWithinPartitions(*order)
    schema = pa.schema([("did", pa.int64()), ("tid", pa.int64()), ("from", pa.int32()), ("to", pa.int32()), ("stays_from", pa.int32()), ("stays_to", pa.int32()), ("source", pa.int64()), ("run", pa.binary()), ("at", pa.int32())])

    def matches(rows, open_start, open_end):
        for did, tid, place, what, other in settle(rows, passage, open_start, open_end):
            if isinstance(what, int):
                yield did, tid, None, None, None, None, None, other, what
                continue
            gone = place - what[1], place - what[0] + passage
            if other[:2] == (did, tid):
                yield did, tid, *gone, other[2] - what[1], other[2] - what[0] + passage, None, None, None
            else:
                yield did, tid, *gone, None, None, other[0], None, None

    def segments(batches):
        """(rows, whether the group may go on before them, whether it may go on behind them)."""
        group, rows, open_start, last = None, [], True, None
        for batch in bounded(batches):
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[4:] == last and row[0] == rows[-1][0]:
                    continue  # a row that the table has twice
                last = row[4:]
                here = row[0].split(b" ", gram)[:gram]
                if here != group:
                    if rows:
                        yield rows, open_start, False
                        open_start = False
                    group, rows = here, []
                elif len(rows) == segment:
                    yield rows, open_start, True
                    rows, open_start = [], True
                rows.append(row)
        if rows:
            yield rows, open_start, True

    def run(batches):
        out = []
        for rows, open_start, open_end in segments(batches):
            if len(rows) > 1 or open_start or open_end:
                out.extend(matches(rows, open_start, open_end))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return ranged.mapInArrow(run, "did long, tid long, from int, to int, stays_from int, stays_to int, source long, run binary, at int")


def repeats(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(found, spans): ``found`` (did, tid, n_words) has every row; ``spans`` (did, tid, spans, sources) has a row for each did and tid with repeats.

    ``spans`` are disjoint runs of words [from, to) in order, ``sources`` doc_ids of earlier documents that have them.
    """
    import pyarrow as pa

    sparse = materialize(suffixes(docs, passage, gram), "suffixes")
    doc = ["did", "tid"]
    texts = sparse.groupBy("whole").agg(F.min("did").alias("first"), F.max("did").alias("last"), F.max("n_words").alias("n_words"))
    copied = materialize(texts.where(F.col("first") < F.col("last")).where(F.col("n_words") >= passage).select("whole", "first"), "suffix-copies")
    copies = materialize(salted_join(sparse.select(*doc, "whole", "n_words"), copied, ["whole"], ["did"], how="inner").where("did <> first").distinct(), "suffix-copy-rows")
    # joins from here on are by stored tables: both sides are exchanged, so adaptive execution can split a hot key
    entries = sparse.join(copies.select(*doc), doc, "left_anti").select(*doc, F.explode("entries").alias("e")).select(*doc, "e.*")
    near = materialize(compare_neighbours(entries), "suffix-neighbours")
    whole = near.where("source is not null").select(*doc, F.struct(F.col("first").alias("from"), (F.col("last") + passage).alias("to")).alias("gone"), F.lit(None).cast("struct<from: int, to: int>").alias("stays"), "source")
    held = near.where("source is null").groupBy(*doc).agg(F.collect_set(F.struct("place", "first", "last")).alias("entries"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(_id().alias("did"), F.xxhash64(text).alias("tid"), text.alias("text"))
    reached = materialize(reaches(named.join(held, doc), passage, gram), "suffix-reaches")
    found = materialize(extend_matches(reached, passage, gram, segment), "suffix-matches")
    discard(reached)
    closed = found.where("run is null").select(*doc, F.struct("from", "to").alias("gone"), F.when(F.col("stays_from").isNotNull(), F.struct(F.col("stays_from").alias("from"), F.col("stays_to").alias("to"))).alias("stays"), "source")
    opened, at = found.where("run is not null").select("run", *doc, "at"), F.struct(*doc, "at")
    firsts = materialize(opened.groupBy("run").agg(F.min(at).alias("kept"), F.max(at).alias("other")).where("kept <> other").select("run", "kept"), "suffix-firsts")
    matched = opened.join(firsts, "run").where(at != F.col("kept"))
    own = (F.col("kept.did") == F.col("did")) & (F.col("kept.tid") == F.col("tid"))
    span = lambda c: F.struct(c.alias("from"), (c + passage).alias("to"))
    matched = matched.select(*doc, span(F.col("at")).alias("gone"), F.when(own, span(F.col("kept.at"))).alias("stays"), F.when(~own, F.col("kept.did")).alias("source"))
    named_source = F.when(F.col("source") != _NO_ID, F.col("source"))
    lists = closed.union(matched).union(whole).groupBy(*doc).agg(F.collect_set("gone").alias("gone"), F.collect_set("stays").alias("stays"), F.collect_set(named_source).alias("sources"))

    def merge(batches):
        import numpy as np

        for batch in bounded(batches):
            spans = []
            for found, stays in zip(batch.column(2), batch.column(3)):
                start, end = (found.values.field(k).to_numpy() for k in (0, 1))
                stay, until = (stays.values.field(k).to_numpy() for k in (0, 1))
                gone = np.zeros(int(max(end.max(), until.max(initial=0))) + 1, np.int32)
                kept = gone.copy()
                for edge, a, b in ((gone, start, end), (kept, stay, until)):
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b, -1)
                removed = (np.cumsum(gone) > 0) & (np.cumsum(kept) == 0)
                edges = np.nonzero(np.diff(removed.astype(np.int8), prepend=0, append=0))[0]
                spans.append([{"from": a, "to": b} for a, b in edges.reshape(-1, 2).tolist()])
            kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(spans, kind), batch.column(4)], ["did", "tid", "spans", "sources"])

    schema = "did long, tid long, spans array<struct<from: int, to: int>>, sources array<long>"
    partly = lists.mapInArrow(merge, schema)
    full = copies.select(*doc, F.array(F.struct(F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to"))).alias("spans"), F.when(F.col("first") != _NO_ID, F.array("first")).otherwise(F.array().cast("array<long>")).alias("sources"))
    spans = materialize(partly.where("size(spans) > 0").union(full), "suffix-spans")
    discard(copied, copies, near, found, firsts)
    return sparse.select(*doc, "n_words"), spans


def find_repeats(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, sources) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Null texts are empty; texts of fewer than ``passage`` words have no repeats. A null doc_id comes
    after all others, and is no source. Rows that repeat both doc_id and text are one document and
    are judged alike; an empty table gives no rows.
    """
    found, spans = repeats(docs, passage, gram, segment)
    out = found.join(spans, ["did", "tid"], "left")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return out.select(
        F.when(F.col("did") != _NO_ID, F.col("did")).alias("doc_id"),
        "n_words",
        F.coalesce(removed, F.lit(0)).alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<struct<from: int, to: int>>")).alias("spans"),
        F.coalesce(F.array_sort("sources"), F.array().cast("array<long>")).alias("sources"),
    )


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and the white space that follows them."""
    import re

    begins = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : begins[a]])
        at = begins[b]
    return "".join(out) + text[at:]


def remove_repeats(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """``docs``, all its columns, with repeated passages taken out of ``text`` and ``n_chars`` (if there) made to fit.

    A document of which no word is left goes; those without repeats are as they were, null texts too.
    """
    import pyarrow as pa

    _, spans = repeats(docs, passage, gram)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__pw_row"), _id().alias("did"), F.xxhash64(text).alias("tid"))
    joined = rows.join(spans.select("did", "tid", "spans"), ["did", "tid"], "left").select("__pw_row", F.col("__pw_row.text").cast("string").alias("__pw_text"), "spans")

    def run(batches):
        for batch in bounded(batches):
            out = []
            for text, found in zip(batch.column(1), batch.column(2)):
                cut = remove_spans(text.as_py(), [(s["from"], s["to"]) for s in found.as_py()])
                out.append(cut if cut.strip(" \t\n\x0b\f\r") else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["__pw_row", "__pw_left"])

    changed = joined.where("spans is not null")
    schema = T.StructType([joined.schema["__pw_row"], T.StructField("__pw_left", T.StringType())])
    left = changed.mapInArrow(run, schema).where("__pw_left is not null")
    fit = {"text": F.col("__pw_left").alias("text"), "n_chars": F.length("__pw_left").cast("long").alias("n_chars")}
    changed = left.select(*[fit.get(c, F.col(f"__pw_row.`{c}`")) for c in docs.columns])
    return changed.union(joined.where("spans is null").select("__pw_row.*"))
