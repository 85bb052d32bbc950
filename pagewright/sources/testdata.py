"""Items and lines from plain documents: one item a line, forty lines a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.arrow import bounded

LINES_PER_PAGE = 40
FONT = 10.5
#: Bytes of lines that are cut into words at once; as items words take some fifteen times that.
LINE_BYTES = 1 << 17


def document_lines(docs: DataFrame) -> DataFrame:
    """(document_id, k, page_number, item_index, str) of documents (doc_id, text): every line, empty ones too; a null text is empty."""
    lines = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "str"))
    return lines.select("document_id", "k", F.floor(F.col("k") / LINES_PER_PAGE + 1).cast("int").alias("page_number"), F.pmod("k", F.lit(LINES_PER_PAGE)).alias("item_index"), "str")


def items_of_documents(docs: DataFrame, columns: bool = False) -> DataFrame:
    """Items with even geometry; with ``columns``, odd items of every third document stand beside the even ones."""
    lines = document_lines(docs)
    two = F.lit(columns) & (F.col("document_id") % 3 == 0)
    x = F.when(two & (F.col("item_index") % 2 == 1), 320.0).otherwise(72.0)
    row = F.when(two, F.floor(F.col("item_index") / 2)).otherwise(F.col("item_index"))
    flat = F.array(F.lit(FONT), F.lit(0.0), F.lit(0.0), F.lit(FONT), x, (700 - 16 * row).cast("double"))
    width = F.when(two, F.least(F.lit(200.0), 0.95 * FONT * F.char_length("str"))).otherwise(0.95 * FONT * F.char_length("str"))
    return lines.select("document_id", "page_number", "item_index", "str", flat.alias("transform"), width.cast("double").alias("width"), F.lit(FONT).alias("height"), F.lit(True).alias("has_eol"))


def pages_of_lines(batches):
    """Arrow batches of whole pages (document_id, page_number, lines) from batches of lines in the order of pages; a batch's last page waits for its rest."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def changes(batch):
        ids = [pc.fill_null(batch.column("document_id"), 0), pc.is_null(batch.column("document_id")), batch.column("page_number")]
        return np.flatnonzero(np.any([np.diff(c.to_numpy(zero_copy_only=False).astype(np.int64)) != 0 for c in ids], axis=0)) + 1

    def pages(batch, firsts):
        line = pa.StructArray.from_arrays([batch.column("item_index"), batch.column("str")], names=["item_index", "str"])
        at = pa.array(firsts)
        lists = pa.ListArray.from_arrays(pa.array(np.append(firsts, batch.num_rows).astype(np.int32)), line)
        return pa.RecordBatch.from_arrays([batch.column("document_id").take(at), batch.column("page_number").take(at), lists], names=["document_id", "page_number", "lines"])

    waiting = []
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = waiting + [batch]
        if not len(changes(batch)) and (not waiting or not len(changes(pa.concat_batches([waiting[-1].slice(waiting[-1].num_rows - 1), batch.slice(0, 1)])))):
            waiting = whole
            continue
        whole = pa.concat_batches(whole)
        firsts = np.append(0, changes(whole))
        yield pages(whole.slice(0, firsts[-1]), firsts[:-1])
        waiting = [pa.concat_batches([whole.slice(firsts[-1])])]
    if waiting:
        yield pages(pa.concat_batches(waiting), np.array([0]))


def words_of_batches(batches):
    """Arrow batches of pages' items, every word of a line one and in odd documents from the last to the first, from batches of pages' lines (item_index, str) in order."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in bounded(batches, most=LINE_BYTES):
        found = batch.column("lines")
        page_ends = found.offsets.to_numpy()
        line = found.values.slice(page_ends[0], page_ends[-1] - page_ends[0])
        words = pc.split_pattern(line.field("str"), " ")
        ends = words.offsets.to_numpy().astype(np.int64)
        words = words.values.slice(ends[0], ends[-1] - ends[0])
        ends -= ends[0]
        count, n = np.diff(ends), len(words)
        first = np.repeat(ends[:-1], count)
        odd = np.fmod(pc.fill_null(batch.column("document_id"), 0).to_numpy(), 2) == 1
        turned = np.repeat(np.repeat(odd, np.diff(page_ends)), count)
        chars = pc.utf8_length(words).to_numpy().astype(np.int64)
        before = np.cumsum(chars + 1) - chars - 1
        x = 72.0 + 5.0 * (before - before[first])
        last = np.repeat(ends[1:], count) - 1
        if turned.any():
            there = np.where(turned, first + last - np.arange(n), np.arange(n))
            words, chars, x = words.take(pa.array(there)), chars[there], x[there]
        matrix = np.zeros((n, 6))
        matrix[:, 0] = matrix[:, 3] = FONT
        matrix[:, 4], matrix[:, 5] = x, np.repeat(700.0 - 16 * line.field("item_index").to_numpy(), count)
        upto = ends[page_ends - page_ends[0]]
        values = {
            "item_index": pa.array((np.arange(n) - np.repeat(upto[:-1], np.diff(upto))).astype(np.int32)),  # by place on the page, so that no line is too long for it
            "str": words,
            "transform": pa.ListArray.from_arrays(pa.array(np.arange(0, 6 * n + 1, 6, dtype=np.int32)), pa.array(matrix.ravel())),
            "width": pa.array(5.0 * chars),
            "height": pa.array(np.full(n, FONT)),
            "has_eol": pa.array(np.arange(n) == last),
        }
        items = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.StructArray.from_arrays(list(values.values()), names=list(values)))
        yield pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("page_number"), items], names=["document_id", "page_number", "items"])
