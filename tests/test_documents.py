"""Lines, segments, page index and exact search."""

import random

import pytest

from pagewright import schemas
from pagewright.operators import exact_search, lines, segments
from pagewright.plans.search import find, ingest


def item(k, text, x=72.0, y=700.0, width=None, size=10.0, eol=False):
    return {"item_index": k, "str": text, "transform": [size, 0.0, 0.0, size, float(x), float(y)], "width": float(width if width is not None else 5 * len(text)), "height": size, "has_eol": eol}


def frame(spark, pages):
    rows = [(d, p, i["item_index"], i["str"], i["transform"], i["width"], i["height"], i["has_eol"]) for (d, p), items in pages.items() for i in items]
    return spark.createDataFrame(rows, schemas.ITEMS)


def texts(items):
    return [line["text"] for line in lines.lines_of_page(items)[1]]


def test_words_on_a_baseline_are_spaced_and_sorted():
    assert texts([item(0, "world", x=110), item(1, "Hello", x=72, width=25)]) == ["Hello world"]
    assert texts([item(0, "Hel", x=72, width=15), item(1, "lo", x=88)]) == ["Hello"]


def test_letters_without_word_spaces_are_not_spaced():
    assert texts([item(0, "中途", x=72, width=20), item(1, "解約", x=100)]) == ["中途解約"]


def test_baselines_within_tolerance_make_one_line_and_rows_run_down():
    got = texts([item(0, "low", y=600), item(1, "a", y=700), item(2, "b", x=80, y=703.9)])
    assert got == ["ab" if 80 - 77 <= 2.5 else "a b", "low"]


def test_line_ends_count_only_where_they_tell_something():
    same = dict(y=700.0)
    assert texts([item(0, "a", eol=True, **same), item(1, "b", x=90, **same), item(2, "c", x=100, **same)]) == ["a", "b c"]
    assert texts([item(k, c, x=72 + 10 * k, eol=True, **same) for k, c in enumerate("abc")]) == ["a b c"]


def test_gutters_split_lines_and_empty_items_keep_indexes():
    size, found = lines.lines_of_page([item(0, ""), item(1, "left", width=20), item(2, "right", x=200)])
    assert size == 10 and [line["text"] for line in found] == ["left", "right"]
    assert [line["item_indexes"] for line in found] == [[1], [2]]
    assert lines.lines_of_page([item(0, "")]) == (0.0, [])


def test_columns_are_read_one_after_the_other(spark):
    rows = [item(2 * k + side, f"{'lr'[side]}{k}", x=72 + 200 * side, y=700 - 16 * k, width=20) for k in range(3) for side in (0, 1)]
    pages = lines.page_lines(frame(spark, {(1, 1): rows, (1, 2): rows[::2]}))
    got = {r.page_number: [(x.column, x.text) for x in r.lines] for r in lines.order_by_column(pages).collect()}
    assert got == {1: [(0, "l0"), (0, "l1"), (0, "l2"), (1, "r0"), (1, "r1"), (1, "r2")], 2: [(0, "l0"), (0, "l1"), (0, "l2")]}
    assert {r.page_number: r.m for r in pages.select("page_number", lines.looks_multi_column(pages.lines).alias("m")).collect()} == {1: True, 2: False}


def line(text, y=700.0, size=10.0, column=0, k=0):
    piece = {"item_index": k, "start": 0, "end": len(text), "item_offset": 0, "item_length": len(text)}
    return {"text": text, "column": column, "pieces": [piece], "item_indexes": [k], "x": 72.0, "y": y, "font_size": size}


def rows(*texts, **more):
    return [line(t, y=700.0 - 16 * k, k=k, **more) for k, t in enumerate(texts)]


def passages(found):
    return [s["original_text"] for s in segments.segments_of_page(found)]


LONG = "This line of body text is long enough to be taken for the page's usual line."


def test_a_paragraph_gap_a_heading_and_a_list_item_begin_a_passage():
    body = rows(LONG, LONG, LONG, LONG)
    body[3]["y"] -= 20
    assert passages(body) == [" ".join([LONG] * 3), LONG]
    body = rows(LONG, LONG, LONG)
    body[2]["font_size"] = 14.0
    assert len(passages(body)) == 2
    assert passages(rows(LONG, "(2) " + LONG)) == [LONG, "(2) " + LONG]
    assert passages(rows(LONG, "However " + LONG)) == [LONG + " However " + LONG]
    gap = rows(LONG, LONG, LONG, "however " + LONG)
    gap[3]["y"] -= 20
    assert len(passages(gap)) == 1


def test_columns_are_hard_borders():
    body = rows(LONG, LONG)
    body[1]["column"] = 1
    assert passages(body) == [LONG, LONG]


def test_fragments_join_a_neighbour_but_provisions_stand_alone():
    assert passages(rows("Terms of use", LONG, LONG)) == ["Terms of use " + LONG + " " + LONG]
    assert passages(rows("第5条　返金不可", "第6条　" + LONG))[0] == "第5条　返金不可"
    body = rows(LONG, LONG, "The end.")
    body[2]["y"] -= 40
    assert passages(body) == [" ".join([LONG, LONG, "The end."])]


def test_no_passage_is_over_the_hard_limit():
    """Where rules alone would leave one: a tail after a cut back, joins that add spaces, long lines."""
    tail = ["Short one with a stop at the end."] + ["w" * 108] * 9
    assert max(map(len, passages(rows(*tail)))) <= 800
    rng = random.Random(3)
    for _ in range(150):
        body = rows(*["".join(rng.choice("ab .漢。") for _ in range(int(rng.paretovariate(0.4)) % 2500 + 1)) for _ in range(rng.randrange(1, 14))])
        for one in body:
            one["y"] -= rng.choice([0, 0, 0, 9])
            one["font_size"] = rng.choice([10.0, 10.0, 13.0])
        found = segments.segments_of_page(body)
        assert all(0 < len(s["original_text"]) <= 800 for s in found)
        kept = "".join("".join(s["original_text"] for s in found).split())
        assert kept == "".join("".join(one["text"] for one in body).split())  # no text is lost or moved
        for a, b in zip(found, found[1:]):
            assert a["context_after"] is not None and b["context_before"] is not None


def test_long_lines_are_cut_at_sentences_then_items_then_anywhere():
    two = line("a" * 500 + "." + "b" * 600)
    assert [len(p["text"]) for p in segments.split_long(two)] == [501, 600]
    by_item = line("a" * 1000)
    by_item["pieces"] = [{"item_index": 0, "start": 0, "end": 700, "item_offset": 0, "item_length": 700}, {"item_index": 1, "start": 700, "end": 1000, "item_offset": 0, "item_length": 300}]
    assert [len(p["text"]) for p in segments.split_long(by_item)] == [700, 300]
    parts = segments.split_long(line("a" * 1700, column=1))
    assert [len(p["text"]) for p in parts] == [800, 800, 100] and {p["column"] for p in parts} == {1}
    assert [p["pieces"][0]["item_offset"] for p in parts] == [0, 800, 1600]


def test_ranges_coalesce_within_an_item():
    parts = segments.split_long(line("a" * 1700))
    assert segments.ranges_of(parts) == [{"item_index": 0, "start_offset": 0, "end_offset": 1700, "whole_item": True}]
    assert segments.ranges_of(parts[1:2]) == [{"item_index": 0, "start_offset": 800, "end_offset": 1600, "whole_item": False}]


@pytest.fixture(scope="module")
def corpus(spark):
    one = [item(0, "返 金ｶ", y=700, width=15), item(1, "ﾞは the cat", x=110, y=700), item(2, "the", y=684), item(3, "CATS the🙂the", y=668)]
    return ingest(frame(spark, {(1, 1): one, (1, 2): [item(0, "no"), item(1, "")], (2, 1): [item(0, "")]}))


def hits(corpus, query):
    return sorted((r.document_id, r.page_number, r.search_start, r.preview_text, [tuple(x) for x in r.ranges]) for r in find(corpus, query).collect())


def test_hits_cross_items_and_lines(corpus):
    assert [h[4] for h in hits(corpus, "返金ガ")] == [[(0, 0, 4, False), (1, 0, 1, False)]]
    crossing = hits(corpus, "the　cats")
    assert [h[4] for h in crossing] == [[(2, 0, 3, False), (3, 0, 4, False)]]
    assert len(hits(corpus, "THE")) == 4
    assert [h[4] for h in hits(corpus, "the🙂t")] == [[(3, 5, 10, False)]]
    assert hits(corpus, "nothing like it") == []
    with pytest.raises(ValueError, match="empty_query"):
        find(corpus, " ​")


def test_query_characters_are_literal(spark):
    page = ingest(frame(spark, {(1, 1): [item(0, r"a.b\E\Q a+b (c [d $1 .*")]}))
    for query in (".", "\\E", "\\Q", "\\E\\Q", "+b", "(c", "[d", "$1", ".*"):
        assert len(hits(page, query)) == r"a.b\e\qa+b(c[d$1.*".count(query.lower()), query


def test_every_hit_reads_back_its_query(spark, corpus):
    from pagewright.functions.text import normalize_with_offsets

    for query in ("the", "返金", "cat", "t h e"):
        got = exact_search.covered_text(corpus.index, find(corpus, query)).collect()
        assert got and {normalize_with_offsets(r.covered)[0] for r in got} == {normalize_with_offsets(query)[0]}


def test_pages_that_search_cannot_reach(corpus):
    assert {r.document_id: r.pages for r in corpus.unsearched.collect()} == {1: [], 2: [1]}


def test_limits_block_but_do_not_hide(spark):
    many = {(7, p): [item(0, "x" * 30)] for p in range(1, 53)}
    assert ingest(frame(spark, many)).pages.count() == 0
    assert [r.kind for r in ingest(frame(spark, many)).violations.collect()] == ["page_count"]
    sideways = spark.createDataFrame([(1, 1, 90)], "document_id long, page_number int, rotate int")
    turned = ingest(frame(spark, {(1, 1): [item(0, "text")], (1, 2): [item(0, "text")]}), sideways)
    assert [r.page_number for r in turned.pages.collect()] == [2] and turned.unsearched.first().pages == [1]


def test_empty_tables(spark):
    empty = ingest(frame(spark, {(1, 1): []}))
    assert empty.segments.count() == empty.index.count() == empty.violations.count() == 0


def test_pages_are_made_in_bounded_parts():
    """A worker never turns a whole Arrow batch of pages into Python values at once."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL("document_id long, page_number int, items array<struct<item_index: int, str: string, transform: array<double>, width: double, height: double, has_eol: boolean>>"))
    pages = [{"document_id": d, "page_number": 1, "items": [item(k, f"word{k}", x=72.0 + 40 * k) for k in range(500)]} for d in range(64)]
    batch = pa.RecordBatch.from_pylist(pages, schema=kind)
    parts = list(lines.lines_of_batches([batch], to_arrow_schema(StructType.fromDDL(schemas.PAGE_LINES))))
    most = max(1, lines.PAGE_BYTES * 64 // batch.nbytes)
    assert batch.nbytes > lines.PAGE_BYTES and max(p.num_rows for p in parts) <= most
    assert [r["document_id"] for p in parts for r in p.to_pylist()] == list(range(64))
    assert parts[0].to_pylist()[0]["lines"][0]["text"] == lines.lines_of_page(pages[0]["items"])[1][0]["text"]


ITEMS_OF_PAGE = "document_id long, page_number int, items array<struct<item_index: int, str: string, transform: array<double>, width: double, height: double, has_eol: boolean>>"


def arrow_schema(spark, ddl):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(lines._schema(spark, ddl))


def odd_page(rng):
    """Heights that drift, items out of order, sizes and line ends of all sorts, letters with and without word spaces."""
    n, ends, y, found = rng.choice([0, 1, 2, 3, 8, 60]), rng.choice([0, 0.1, 0.5, 0.95, 1]), 700.0, []
    for k in sorted(rng.sample(range(1000), n)):
        y += rng.choice([0, 0, 0, -16, -3, 3.9, 4.2, 16])
        text = rng.choice(["", "a", "word", "\u4e2d\u9014", "\u00e9t\u00e9", "\u89e3a", "a\u89e3", " x", "x ", " ", "\U0001f600", "\U00020000", "tail\u3000"])
        one = item(k, text, x=rng.choice([72, 80, 90.5, 200, 72 + 1.7 * k]), y=y, size=rng.choice([10.0, 10.0, 9.0, 0.0]), width=rng.choice([0, 3.3, 5 * len(text)]), eol=rng.random() < ends)
        one["transform"][2] = rng.choice([0.0, 0.0, 1.3])
        found.append(one | {"height": rng.choice([10.0, 0.0])})
    return found


def test_lines_by_column_are_the_lines_of_each_page(spark):
    import pyarrow as pa

    rng, kind, out = random.Random(5), arrow_schema(spark, ITEMS_OF_PAGE), arrow_schema(spark, schemas.PAGE_LINES)
    for k in range(60):
        pages = [{"document_id": d, "page_number": 1, "items": odd_page(rng)} for d in range(1, 25)]
        batch = pa.RecordBatch.from_pylist(pages, schema=kind).slice(k % 3)
        assert lines._columns(batch.column("items")) is not None
        got = lines.lines_of_batch(batch, out)
        got.validate(full=True)
        want = [lines.lines_of_page(p["items"]) for p in batch.to_pylist()]
        assert [(p["font_size"], p["lines"]) for p in got.to_pylist()] == want


def test_what_columns_do_not_hold_is_left_to_rows(spark):
    import pyarrow as pa

    kind, out = arrow_schema(spark, ITEMS_OF_PAGE), arrow_schema(spark, schemas.PAGE_LINES)
    for odd in ({"has_eol": None}, {"width": float("inf")}, {"height": None}):
        pages = [{"document_id": 1, "page_number": 1, "items": [item(0, "a"), item(1, "b", x=90) | odd]}]
        batch = pa.RecordBatch.from_pylist(pages, schema=kind)
        assert lines._columns(batch.column("items")) is None
        (got,) = lines.lines_of_batch(batch, out).to_pylist()
        assert [one["text"] for one in got["lines"]] == ["a b"]


def test_words_become_items_a_part_at_a_time(spark):
    """A worker has the words of a small part of a batch as items, and hands on lines without their pieces."""
    import pyarrow as pa

    from pagewright.sources import testdata

    kind = arrow_schema(spark, "document_id long, page_number int, lines array<struct<item_index: int, str: string>>")
    pages = [{"document_id": d, "page_number": 1, "lines": [{"item_index": k, "str": f"w{k} \u00e9  {d} " * 20} for k in range(40)]} for d in range(100)]
    batch = pa.RecordBatch.from_pylist(pages, schema=kind)
    parts = list(testdata.words_of_batches([batch]))
    assert batch.nbytes > 4 * testdata.LINE_BYTES and max(p.nbytes for p in parts) < 32 * testdata.LINE_BYTES
    first, second = (p["items"] for p in parts[0].to_pylist()[:2])
    assert [i["str"] for i in first[:4]] == ["w0", "\u00e9", "", "0"] and [i["str"] for i in second[:5]] == ["", "1", "", "\u00e9", "w0"]
    assert [i["transform"][4] for i in first[:4]] == [72.0, 87.0, 97.0, 102.0] and [i["item_index"] for i in second] == list(range(len(second)))
    out = arrow_schema(spark, "document_id long, page_number int, line_no int, text string, words int")
    rows = [r for b in lines.rows_of_lines(lines.lines_of_batches(parts, arrow_schema(spark, schemas.PAGE_LINES)), out) for r in b.to_pylist()]
    want = [(p["document_id"], 1, k + 1, " ".join(line["str"].split()), len(line["str"].split())) for p in pages for k, line in enumerate(p["lines"])]
    assert [tuple(r.values()) for r in rows] == want


def test_a_line_of_very_many_words_does_not_run_into_the_next(spark, tmp_path):
    from pagewright.plans import catalogue

    n = 100_004
    spark.createDataFrame([(1, "a " * n + "\nb c"), (2, "a " * n + "\nb c"), (3, None), (4, "\n \n")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.words_to_lines(spark, str(tmp_path)).orderBy("document_id", "line_no").collect()
    assert [(r.document_id, r.page_number, r.line_no, r.words) for r in got] == [(d, 1, k, w) for d in (1, 2) for k, w in ((1, n), (2, 2))]
    assert {r.text for r in got} == {" ".join("a" * n), "b c"}


def test_pages_are_whole_wherever_batches_of_lines_end(spark):
    import pyarrow as pa

    from pagewright.sources import testdata

    kind = arrow_schema(spark, "document_id long, page_number int, item_index int, str string")
    want = [(d, p, [{"item_index": k, "str": f"{d} {p} {k}"} for k in range(n)]) for d, p, n in ((None, 1, 3), (0, 1, 1), (0, 2, 7), (1, 2, 40), (5, 1, 2))]
    whole = pa.RecordBatch.from_pylist([{"document_id": d, "page_number": p} | line for d, p, found in want for line in found], schema=kind)
    for size in (1, 2, 3, 7, 11, 53, 100):
        parts = [whole.slice(0, 0)] + [whole.slice(k, size) for k in range(0, whole.num_rows, size)]
        assert [tuple(r.values()) for b in testdata.pages_of_lines(parts) for r in b.to_pylist()] == want
    assert list(testdata.pages_of_lines([])) == []
