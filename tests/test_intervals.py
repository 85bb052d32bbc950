"""Intervals against sorted pieces."""

import random
import time

import numpy as np

from pagewright.functions.intervals import overlaps, touched
from pagewright.operators import exact_search


def test_all_meetings():
    rng = random.Random(1)
    for _ in range(200):
        cuts = sorted(rng.sample(range(60), 2 * rng.randrange(0, 9)))
        pieces = list(zip(cuts[::2], cuts[1::2]))
        intervals = [(a := rng.randrange(60), a + rng.randrange(12)) for _ in range(9)]
        starts, ends = (np.array([p[k] for p in pieces], np.int64) for k in (0, 1))
        first, last = (np.array([i[k] for i in intervals]) for k in (0, 1))
        want = [(i, k, max(a, s), min(b, e)) for i, (a, b) in enumerate(intervals) for k, (s, e) in enumerate(pieces) if s < b and e > a and b > a]
        assert list(zip(*(x.tolist() for x in overlaps(starts, ends, first, last)))) == want
        low, high = touched(starts, ends, first, last)
        assert [h - w for w, h in zip(low.tolist(), high.tolist())] == [sum(i == k for i, *_ in want) for k in range(9)]


def test_a_page_of_many_pieces_and_hits(spark):
    """100,000 pieces and 10,000 hits of one page, each hit across the border of two items."""
    n = 100_000
    pieces = [(k, 10 * k, 10 * k + 10, 0) for k in range(n)]
    index = spark.createDataFrame([(1, 1, "ab" + "x" * (10 * n - 2), "q" * (10 * n), pieces, list(range(5, 10 * n - 10, 100)))], "document_id long, page_number int, original_text string, search_text string, pieces array<struct<item_index: int, start: int, end: int, item_offset: int>>, firsts array<int>")
    from pyspark.sql import functions as F

    covered = index.select(exact_search._cover()("pieces", "firsts", F.transform("firsts", lambda x: x + 7)).alias("c"))
    covered.limit(0).collect()
    began = time.perf_counter()
    found = covered.first().c
    assert time.perf_counter() - began < 20
    assert len(found) == 10_000
    assert [[tuple(r) for r in hit] for hit in found[:2]] == [[(0, 5, 10, False), (1, 0, 2, False)], [(10, 5, 10, False), (11, 0, 2, False)]]
