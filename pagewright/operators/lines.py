"""Items to lines in reading order.

Items are gathered by page with one shuffle on (document_id, page_number); a page is the unit that no rule
crosses. What follows works on pages as rows of arrays and needs no further shuffle.
"""

from __future__ import annotations

from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import limits, schemas
from pagewright.functions.arrow import bounded, python_rows
from pagewright.functions.characters import is_cjk, is_space
from pagewright.functions.text import js_round


def font_size(transform: list[float], height: float) -> float:
    """[H20]"""
    a, b = transform[2], transform[3]
    return (a * a + b * b) ** 0.5 or height


def wants_space(before: str, after: str, gap: float, size: float) -> bool:
    """[B4] Whether a gap between two items of a line is a word break; letters without word spaces never have one."""
    if not before or not after:
        return False
    edges = before[-1], after[0]
    return not any(is_space(c) or is_cjk(c) for c in edges) and gap > limits.SPACE_GAP_RATIO * size


def lines_of_page(items: list[dict]) -> tuple[float, list[dict]]:
    """[K1] The page's font size and its lines, topmost first, from items in item order."""
    found = [i for i in items if i["str"]]
    if not found:
        return 0.0, []
    for i in found:
        i["size"] = font_size(i["transform"], i["height"])
    page_size = median(i["size"] for i in found)
    unit = page_size if page_size > 0 else 1.0
    marked = sum(bool(i["has_eol"]) for i in found) / len(found)
    trust = 0 < marked < limits.EOL_TRUST_CEILING
    rows: list[list[dict]] = []
    ended = False
    for i in found:
        if not rows or trust and ended or abs(i["transform"][5] - rows[-1][0]["transform"][5]) > limits.BASELINE_TOLERANCE * unit:
            rows.append([])
        rows[-1].append(i)
        ended = bool(i["has_eol"])
    lines = []
    for row in rows:
        size, y = max(i["size"] for i in row), row[0]["transform"][5]
        run: list[dict] = []
        for i in sorted(row, key=lambda i: i["transform"][4]):
            if run and i["transform"][4] - run[-1]["transform"][4] - run[-1]["width"] > limits.COLUMN_GAP_RATIO * unit:
                lines.append(_line(run, y, size))
                run = []
            run.append(i)
        lines.append(_line(run, y, size))
    lines.sort(key=lambda line: -line["y"])
    return page_size, lines


def _line(run: list[dict], y: float, size: float) -> dict:
    text, pieces, before = "", [], None
    for i in run:
        if before is not None and wants_space(before["str"], i["str"], i["transform"][4] - before["transform"][4] - before["width"], before["size"]):
            text += " "  # belongs to no item
        n = len(i["str"])
        pieces.append({"item_index": i["item_index"], "start": len(text), "end": len(text) + n, "item_offset": 0, "item_length": n})
        text += i["str"]
        before = i
    return {"text": text, "column": 0, "pieces": pieces, "item_indexes": sorted(i["item_index"] for i in run), "x": run[0]["transform"][4], "y": y, "font_size": size}


#: Bytes of items that a worker makes lines of at once; a page of more is taken by itself.
PAGE_BYTES = 1 << 20


def lines_of_batches(batches, schema):
    """Arrow batches of pages' lines from batches of pages' items, cut by PAGE_BYTES."""
    for batch in bounded(batches, most=PAGE_BYTES):
        yield lines_of_batch(batch, schema)


def lines_of_batch(batch, schema):
    """[K1] ``lines_of_page`` for every page of a batch, by columns; what columns don't hold (nulls, other matrices, numbers without end) is left to it."""
    import pyarrow as pa

    found = _columns(batch.column("items"))
    if found is not None:
        sizes, lines = _lines_by_column(*found, schema.field("lines").type)
        return pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("page_number"), pa.array(sizes), lines], schema=schema)
    rows = []
    for row in python_rows(batch):
        size, lines = lines_of_page(row["items"])
        rows.append({"document_id": row["document_id"], "page_number": row["page_number"], "font_size": size, "lines": lines})
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _columns(items):
    """The number of pages and, of items with text, the page, text and values; None if one of them is null, not finite or not where it should be."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not pa.types.is_list(items.type) or items.null_count:
        return None
    ends = items.offsets.to_numpy()
    flat = items.values.slice(ends[0], ends[-1] - ends[0])
    text, matrix = flat.field("str"), flat.field("transform")
    values = [flat.field(name) for name in ("item_index", "width", "height", "has_eol")]
    if flat.null_count or not pa.types.is_string(text.type) or not pa.types.is_list(matrix.type) or any(column.null_count for column in (text, matrix, *values)):
        return None
    at = matrix.offsets.to_numpy()
    entries = matrix.values
    if (np.diff(at) < 6).any() or entries.slice(at[0], at[-1] - at[0]).null_count:
        return None
    entries = entries.to_numpy(zero_copy_only=False)
    a, b, x, y = (entries[at[:-1] + k] for k in (2, 3, 4, 5))
    index, width, height, eol = (column.to_numpy(zero_copy_only=False) for column in values)
    with np.errstate(all="ignore"):
        size = np.sqrt(a * a + b * b)
        size = np.where(size != 0, size, height)
        if not np.isfinite(x + y + width + size).all():
            return None
    page = np.repeat(np.arange(len(items)), np.diff(ends))
    full = pc.binary_length(text).to_numpy() > 0
    if not full.all():
        text = text.filter(pa.array(full))
        page, index, size, x, y, width, eol = (column[full] for column in (page, index, size, x, y, width, eol))
    return len(items), page, text, index, size, x, y, width, eol


def _lines_by_column(pages, page, text, index, size, x, y, width, eol, kind):
    """The pages' font sizes and their lines as an array of ``kind``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n, sizes = len(page), np.zeros(pages)
    if not n:
        return sizes, pa.ListArray.from_arrays(pa.array(np.zeros(pages + 1, np.int32)), pa.array([], kind.value_type), type=kind)
    count = np.bincount(page, minlength=pages)
    some, first = count > 0, np.concatenate(([0], np.cumsum(count)[:-1]))
    in_order = size if size.min() == size.max() else size[np.lexsort((size, page))]
    first, held = first[some], count[some]
    low, high = in_order[first + (held - 1) // 2], in_order[first + held // 2]
    sizes[some] = np.where(held % 2 == 1, high, (low + high) / 2)
    unit = np.where(sizes > 0, sizes, 1.0)
    trust = np.zeros(pages, bool)
    marked = np.add.reduceat(eol.astype(np.int64), first) / held
    trust[some] = (0 < marked) & (marked < limits.EOL_TRUST_CEILING)

    # Items in a row on one height stay together; only the first of them is held against the row so far.
    ended = np.ones(n, bool)
    ended[1:] = (page[1:] != page[:-1]) | trust[page[1:]] & eol[:-1]
    heads = np.flatnonzero(ended | np.concatenate(([True], y[1:] != y[:-1])))
    begins, y0 = [], 0.0
    for end, here, most in zip(ended[heads].tolist(), y[heads].tolist(), (limits.BASELINE_TOLERANCE * unit)[page[heads]].tolist()):
        begin = end or abs(here - y0) > most
        if begin:
            y0 = here
        begins.append(begin)
    row_first = heads[np.array(begins)]
    row = np.zeros(n, np.int64)
    row[row_first[1:]] = 1
    row = np.cumsum(row)

    order = None  # of the items on their lines, where it isn't theirs
    if ((x[1:] < x[:-1]) & (row[1:] == row[:-1])).any():
        order = np.lexsort((x, row))
        x, width, size_at = x[order], width[order], size[order]
    else:
        size_at = size
    gap = np.zeros(n)
    gap[1:] = x[1:] - x[:-1] - width[:-1]
    cut = np.concatenate(([True], row[1:] != row[:-1])) | (gap > (limits.COLUMN_GAP_RATIO * unit)[page])
    line_first = np.flatnonzero(cut)
    line_row = row[line_first]
    line_page, line_y = page[line_first], y[row_first][line_row]
    line_size = np.maximum.reduceat(size, row_first)[line_row]
    length = np.diff(np.append(line_first, n))
    if ((line_y[1:] > line_y[:-1]) & (line_page[1:] == line_page[:-1])).any():
        down = np.lexsort((-line_y, line_page))
        length, line_y, line_size = length[down], line_y[down], line_size[down]
        moved = np.repeat(line_first[down] - np.cumsum(length) + length, length) + np.arange(n)
        x, gap, size_at, cut = x[moved], gap[moved], size_at[moved], cut[moved]
        order = moved if order is None else order[moved]
        line_first = np.cumsum(length) - length
    if order is not None:
        index, text = index[order], text.take(pa.array(order))

    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    spaced = np.zeros(n, bool)
    spaced[1:] = ~cut[1:] & (gap[1:] > limits.SPACE_GAP_RATIO * size_at[:-1])
    spaced[1:] &= _lettered(text, data[at[1:] - 1], -1)[:-1] & _lettered(text, data[at[:-1]], 0)[1:]
    data = np.insert(data, at[:-1][spaced], 32)  # belongs to no item
    ends = np.append(at[line_first] + (np.cumsum(spaced) - spaced)[line_first], len(data))
    texts = pa.StringArray.from_buffers(len(line_first), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
    chars = pc.utf8_length(text).to_numpy().astype(np.int64)
    end = np.cumsum(chars + spaced)
    end -= np.repeat((end - chars)[line_first], length)
    line_ends = pa.array(np.append(line_first, n).astype(np.int32))
    values = {"item_index": index, "start": end - chars, "end": end, "item_offset": np.zeros(n, np.int32), "item_length": chars}
    line = np.repeat(np.arange(len(line_first)), length)
    rising = index if not ((index[1:] < index[:-1]) & ~cut[1:]).any() else index[np.lexsort((index, line))]
    kinds = {field.name: field.type for field in kind.value_type}
    parts = list(kinds["pieces"].value_type)
    pieces = pa.StructArray.from_arrays([pa.array(values[part.name].astype(np.int32)) for part in parts], fields=parts)
    made = {
        "text": texts,
        "column": pa.array(np.zeros(len(line_first), np.int32)),
        "pieces": pa.ListArray.from_arrays(line_ends, pieces, type=kinds["pieces"]),
        "item_indexes": pa.ListArray.from_arrays(line_ends, pa.array(rising.astype(np.int32)), type=kinds["item_indexes"]),
        "x": pa.array(x[line_first]),
        "y": pa.array(line_y),
        "font_size": pa.array(line_size),
    }
    columns = [made[name] for name in kinds]
    upto = np.concatenate(([0], np.cumsum(np.bincount(line_page, minlength=pages))))
    return sizes, pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)), type=kind)


def _lettered(text, bytes_at_edge, edge):
    """Whether the first (0) or last (-1) character of each text is one that a space may stand beside."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = lambda c: not (is_space(c) or is_cjk(c))
    out = np.array([plain(chr(c)) for c in range(128)] + [False] * 128)[bytes_at_edge]
    wide = np.flatnonzero(bytes_at_edge >= 128)
    if len(wide):
        found = pc.utf8_slice_codeunits(text.take(pa.array(wide)), edge, None if edge else 1).dictionary_encode()
        out[wide] = np.array([plain(c) for c in found.dictionary.to_pylist()])[found.indices.to_numpy()]
    return out


def page_lines(items: DataFrame) -> DataFrame:
    """(document_id, page_number, font_size, lines) of items; lines are topmost first."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_schema(items.sparkSession, schemas.PAGE_LINES))
    item = F.struct("item_index", "str", "transform", "width", "height", "has_eol")
    pages = items.where("str is not null").groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return pages.mapInArrow(lambda batches: lines_of_batches(batches, schema), schemas.PAGE_LINES)


def rows_of_lines(batches, schema):
    """Arrow batches of document_id, page_number, line_no from 1, text and words (its items) from batches of pages' lines; pieces stay where they were made."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        found = batch.column("lines")
        count = pc.list_value_length(found).to_numpy()
        page, flat = pa.array(np.repeat(np.arange(len(found)), count)), found.flatten()
        number = np.arange(len(page)) - np.repeat(np.cumsum(count) - count, count) + 1
        words = pc.list_value_length(flat.field("pieces"))
        yield pa.RecordBatch.from_arrays([batch.column("document_id").take(page), batch.column("page_number").take(page), pa.array(number.astype(np.int32)), flat.field("text"), words], schema=schema)


def lines_by_row(rows: DataFrame, items_of_batches) -> DataFrame:
    """(document_id, page_number, line_no, text, words) of pages whose items ``items_of_batches`` makes in workers, from Arrow batches of ``rows``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind, ddl = to_arrow_schema(_schema(rows.sparkSession, schemas.PAGE_LINES)), "document_id long, page_number int, line_no int, text string, words int"
    schema = to_arrow_schema(_schema(rows.sparkSession, ddl))
    return rows.mapInArrow(lambda batches: rows_of_lines(lines_of_batches(items_of_batches(batches), kind), schema), ddl)


def _schema(spark, ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def explode_lines(pages: DataFrame) -> DataFrame:
    """One row per line: document_id, page_number, line_no from 1, and the line's fields."""
    return pages.select("document_id", "page_number", F.posexplode("lines").alias("k", "line")).select("document_id", "page_number", (F.col("k") + 1).alias("line_no"), "line.*")


def looks_multi_column(lines: Column) -> Column:
    """[B5, D6] Whether at least half of the baselines (to a tenth) hold more than one line."""
    keys = F.transform(lines, lambda line: js_round(line["y"] * 10))
    distinct = F.array_distinct(keys)
    shared = F.filter(distinct, lambda k: F.size(F.filter(keys, lambda other: other == k)) > 1)
    return F.coalesce((F.size(lines) > 0) & (F.size(shared) / F.when(F.size(distinct) > 0, F.size(distinct)) >= limits.MULTI_COLUMN_SHARE), F.lit(False))


def order_by_column(pages: DataFrame) -> DataFrame:
    """[K14] Lines by column, then from the top; pages without a gutter keep their order. Native: arrays, no shuffle."""
    gutter = limits.COLUMN_GAP_RATIO * F.when(F.col("font_size") > 0, F.col("font_size")).otherwise(1.0)
    lefts = F.array_sort(F.array_distinct(F.transform("lines", lambda line: line["x"])))
    pairs = F.zip_with(F.slice("__lefts", 1, F.greatest(F.size("__lefts") - 1, F.lit(0))), F.slice("__lefts", 2, F.greatest(F.size("__lefts") - 1, F.lit(0))), lambda a, b: F.when(b - a > F.col("__gutter"), b))
    with_lefts = pages.withColumn("__lefts", lefts).withColumn("__gutter", gutter)
    with_edges = with_lefts.withColumn("__edges", F.filter(pairs, lambda b: b.isNotNull()))
    keyed = F.transform("lines", lambda line, k: F.struct(F.size(F.filter("__edges", lambda b: line["x"] >= b)).alias("column"), (-line["y"]).alias("down"), k.alias("k"), line.alias("line")))
    ordered = F.transform(F.array_sort(keyed), lambda e: e["line"].withField("column", e["column"]))
    return with_edges.select("document_id", "page_number", "font_size", F.when(F.size("__edges") > 0, ordered).otherwise(F.col("lines")).alias("lines"))


def page_facts(items: DataFrame, pages: DataFrame, rotations: DataFrame | None = None) -> DataFrame:
    """[A2, D8] (document_id, page_number, character_count, is_rotated, has_no_text, is_multi_column).

    Pages of ``rotations`` (document_id, page_number, rotate) that stand sideways have no characters and count as rotated, not as empty; pages it doesn't list stand upright.
    """
    facts = pages.select("document_id", "page_number", F.aggregate("lines", F.lit(0).cast("long"), lambda n, line: n + F.char_length(line["text"])).alias("chars"), looks_multi_column(F.col("lines")).alias("many"))
    every = items.select("document_id", "page_number").distinct()
    joined = every.join(facts, ["document_id", "page_number"], "left")
    if rotations is not None:
        joined = joined.join(rotations.select("document_id", "page_number", "rotate"), ["document_id", "page_number"], "full_outer")
    else:
        joined = joined.withColumn("rotate", F.lit(0))
    turned = F.pmod(F.coalesce("rotate", F.lit(0)), F.lit(180)) != 0
    chars = F.when(turned, 0).otherwise(F.coalesce("chars", F.lit(0)))
    return joined.select("document_id", "page_number", chars.cast("long").alias("character_count"), turned.alias("is_rotated"), (~turned & (chars == 0)).alias("has_no_text"), (~turned & F.coalesce("many", F.lit(False))).alias("is_multi_column"))


def unsearched_pages(facts: DataFrame) -> DataFrame:
    """[D24, G1] Per document the sorted distinct pages that search can't reach: rotated or without text."""
    lists = facts.groupBy("document_id").agg(F.collect_set(F.when(F.col("is_rotated"), F.col("page_number"))).alias("a"), F.collect_set(F.when(F.col("has_no_text"), F.col("page_number"))).alias("b"))
    return lists.select("document_id", F.array_sort(F.array_union("a", "b")).alias("pages"))
