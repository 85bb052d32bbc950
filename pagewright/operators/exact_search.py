"""Page index and exact search."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import limits
from pagewright.functions.arrow import bounded
from pagewright.functions.characters import SPACE
from pagewright.functions.intervals import overlaps
from pagewright.functions.text import hit_key, normalize_for_search, normalize_with_offsets, trim_space


def page_pieces(lines: Column) -> Column:
    """[E10] The pieces of a page's lines (item_index, start, end, item_offset), placed in the page's text, whose lines are joined by line feeds."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<item_index: int, start: int, end: int, item_offset: int>>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        placed = F.transform(line["pieces"], lambda p: F.struct(p["item_index"].alias("item_index"), (p["start"] + acc["at"]).alias("start"), (p["end"] + acc["at"]).alias("end"), p["item_offset"].alias("item_offset")))
        return F.struct((acc["at"] + F.char_length(line["text"]) + 1).alias("at"), F.concat(acc["found"], placed).alias("found"))

    return F.aggregate(lines, start, step, lambda acc: acc["found"])


#: Bytes of pages that a worker folds at once; their places take several times as many.
FOLD_BYTES = 1 << 20


def page_texts(pages: DataFrame) -> DataFrame:
    """[K8] (document_id, page_number, original_text, pieces): lines are joined by line feeds, which belong to no item."""
    text = F.array_join(F.transform("lines", lambda line: line["text"]), "\n")
    return pages.select("document_id", "page_number", text.alias("original_text"), page_pieces(F.col("lines")).alias("pieces"))


def fold_texts(texts: DataFrame) -> DataFrame:
    """[K9] Adds the search text and its places to ``page_texts``; what need not be folded but for case isn't looked at letter by letter. Workers fold FOLD_BYTES at a time."""
    names = ["document_id", "page_number", "original_text", "search_text", "source_start", "source_end", "pieces"]

    def run(batches):
        import numpy as np

        for batch in bounded(batches, most=FOLD_BYTES):
            found, starts, ends = [], [], []
            for t in batch.column(2).to_pylist():
                if t is None:
                    text, first, last = None, np.zeros(0, np.int32), np.zeros(0, np.int32)
                elif t.isascii():
                    code = np.frombuffer(t.encode(), np.uint8)
                    first = np.nonzero((code != 32) & ((code < 9) | (code > 13)))[0].astype(np.int32)
                    text, last = code[first].tobytes().decode().lower(), first + 1
                else:
                    text, *both = normalize_with_offsets(t)
                    first, last = (np.array(x, np.int32) for x in both)
                found.append(text)
                starts.append(first)
                ends.append(last)
            edges = pa.array(np.cumsum([0, *map(len, starts)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32))) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.string()), *lists, batch.column(3)], names)

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    made = f"document_id {kinds['document_id']}, page_number {kinds['page_number']}, original_text string, search_text string, source_start array<int>, source_end array<int>, pieces {kinds['pieces']}"
    return texts.select("document_id", "page_number", "original_text", "pieces").mapInArrow(run, made)


def page_index(pages: DataFrame) -> DataFrame:
    """[K8, K9] (document_id, page_number, original_text, search_text, source_start, source_end, pieces).

    ``source_*`` has an entry for each character of the search text; ``pieces`` says which
    characters of the original text are which item's. Store it where the same pages are searched more than once.
    """
    return fold_texts(page_texts(pages))


def search_texts(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, search_text): folded without places, for searches that need no more."""
    texts = page_texts(pages)
    return texts.select("document_id", "page_number", normalize_for_search(F.col("original_text")).alias("search_text"))


def pages_with(pages: DataFrame, query: str) -> DataFrame:
    """The pages that hold the query. Folding without places comes first, for ASCII texts in the JVM."""
    text = F.array_join(F.transform("lines", lambda line: line["text"]), "\n")
    return pages.where(F.contains(normalize_for_search(text), F.lit(folded_query(query))))


def search_pages(pages: DataFrame, query: str) -> DataFrame:
    """[K10] Exact search in pages that have no stored index: only pages that hold the query are indexed."""
    return exact_search(page_index(pages_with(pages, query)), query)


def folded_query(query: str) -> str:
    """The search form of a query; one of white space alone raises ValueError (``empty_query``)."""
    wanted = normalize_with_offsets(query)[0]
    if not wanted:
        raise ValueError("empty_query")
    return wanted


def starts_of(text: Column, query: str) -> Column:
    """[H11] Where a literal occurs, from 0, without overlaps: running lengths of what lies between the occurrences."""
    parts = F.split(text, re.escape(query) if query.isascii() and query.isalnum() else "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    n = len(query)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda acc, part: F.struct((acc["at"] + F.char_length(part) + n).cast("int").alias("at"), F.concat(acc["found"], F.array((acc["at"] + F.char_length(part)).cast("int"))).alias("found"))
    found = F.aggregate(parts, start, step, lambda acc: acc["found"])
    return F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))  # the last part ends without an occurrence


def preview(original: Column, first: Column, last: Column) -> Column:
    """[E12, H12] The match with some context, white space collapsed, and ellipses where text was left out."""
    begin = F.greatest(first - limits.PREVIEW_MARGIN, F.lit(0))
    end = F.least(last + limits.PREVIEW_MARGIN, F.char_length(original))
    shown = trim_space(F.regexp_replace(original.substr(begin + 1, end - begin), f"[{SPACE}]+", " "))
    return F.concat(F.when(begin > 0, "…").otherwise(""), shown, F.when(end < F.char_length(original), "…").otherwise(""))


RANGES = "array<struct<item_index: int, start_offset: int, end_offset: int, whole_item: boolean>>"


def _cover():
    """[C6, C11, E9] For a page's pieces and its hits' first and last characters, each hit's ranges of items, as an Arrow function; what goes on in the same item is one range.

    All hits of a batch of pages meet all its pieces at once, by place, so the work follows the ranges that come out.
    """

    @F.arrow_udf(f"array<{RANGES}>")
    def cover(pieces: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        import numpy as np

        flat, sizes, hits = pieces.flatten(), pieces.value_lengths().fill_null(0).to_numpy(), firsts.value_lengths().fill_null(0).to_numpy()
        item, start, end, offset = (flat.field(flat.type.get_field_index(c)).to_numpy().astype(np.int64) for c in ("item_index", "start", "end", "item_offset"))
        first, last = (x.flatten().to_numpy().astype(np.int64) for x in (firsts, lasts))
        page = max(end.max(initial=0), last.max(initial=0)) + 1  # pages one after the other, none reaching into the next
        lift, raised = np.repeat(np.arange(len(sizes)) * page, sizes), np.repeat(np.arange(len(hits)) * page, hits)
        hit, piece, a, b = overlaps(start + lift, end + lift, first + raised, last + raised)
        shift = offset[piece] - start[piece] - lift[piece]
        item, a, b = item[piece], a + shift, b + shift
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1]) | (item[1:] != item[:-1]) | (a[1:] != b[:-1])
        ends = np.append(new[1:], True)[: len(new)]
        values = [pa.array(x, pa.int32()) for x in (item[new], a[new], b[ends])]
        found = pa.StructArray.from_arrays([*values, pa.array(np.zeros(len(values[0]), bool))], ["item_index", "start_offset", "end_offset", "whole_item"])
        inner = np.append(0, np.cumsum(np.bincount(hit[new], minlength=len(first))))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(hits)), pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), found))

    return cover


def exact_search(index: DataFrame, query: str) -> DataFrame:
    """[K10] Every occurrence of ``query`` in a page index: document_id, page_number, hit_key, search_start, ranges, preview_text.

    The query is folded as the pages are; one of white space alone raises ValueError (``empty_query``). Narrow: a page's row
    is searched by built-in functions and only rows with hits go on. Order by page_number and search_start for reading.
    """
    wanted = folded_query(query)
    pages = index.where(F.contains("search_text", F.lit(wanted))).withColumn("starts", starts_of(F.col("search_text"), wanted))
    pages = pages.withColumn("firsts", F.transform("starts", lambda s: F.element_at("source_start", s + 1))).withColumn("lasts", F.transform("starts", lambda s: F.element_at("source_end", s + len(wanted))))
    pages = pages.withColumn("covered", _cover()("pieces", "firsts", "lasts"))
    # hits are made within the page's row, so its arrays aren't repeated for each
    hit = lambda x: F.struct(x["starts"].alias("search_start"), x["covered"].alias("ranges"), preview(F.col("original_text"), x["firsts"], x["lasts"]).alias("preview_text"))
    hits = pages.select("document_id", "page_number", F.explode(F.transform(F.arrays_zip("starts", "covered", "firsts", "lasts"), hit)).alias("h"))
    return hits.select("document_id", "page_number", hit_key(F.col("page_number"), F.col("h.search_start")).alias("hit_key"), "h.search_start", "h.ranges", "h.preview_text")


def count_hits(texts: DataFrame, query: str) -> DataFrame:
    """(document_id, page_number, hits) from ``texts`` (document_id, page_number, original_text) where only counts are asked for: no places are made."""
    wanted = folded_query(query)
    found = texts.select("document_id", "page_number", normalize_for_search(F.col("original_text")).alias("t")).where(F.contains("t", F.lit(wanted)))
    rest = F.octet_length(F.replace(F.col("t"), F.lit(wanted), F.lit("")))
    return found.select("document_id", "page_number", ((F.octet_length("t") - rest) / len(wanted.encode())).cast("int").alias("hits"))


def covered_text(index: DataFrame, hits: DataFrame) -> DataFrame:
    """[K26] (document_id, page_number, hit_key, covered): the text that a hit's ranges cover, read back from the page index."""
    both = hits.select("document_id", "page_number", "hit_key", "ranges").join(index.select("document_id", "page_number", "original_text", "pieces"), ["document_id", "page_number"])

    def of_range(r: Column) -> Column:
        own = F.filter("pieces", lambda p: (p["item_index"] == r["item_index"]) & (p["item_offset"] < r["end_offset"]) & (p["item_offset"] + p["end"] - p["start"] > r["start_offset"]))

        def part(p: Column) -> Column:
            begin = F.greatest(r["start_offset"], p["item_offset"])
            end = F.least(r["end_offset"], p["item_offset"] + p["end"] - p["start"])
            return F.col("original_text").substr(p["start"] + begin - p["item_offset"] + 1, end - begin)

        return F.array_join(F.transform(own, part), "")

    return both.select("document_id", "page_number", "hit_key", F.array_join(F.transform("ranges", of_range), "").alias("covered"))
