"""Functions for SQL."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagewright import limits
from pagewright.functions.characters import SPACE
from pagewright.functions.text import normalize_with_offsets

HITS = "search_start int, source_start int, source_end int, preview_text string"
_SPACES = re.compile(f"[{SPACE}]+")


def _preview(text: str, first: int, last: int) -> str:
    """As ``exact_search.preview``."""
    begin, end = max(0, first - limits.PREVIEW_MARGIN), min(len(text), last + limits.PREVIEW_MARGIN)
    shown = _SPACES.sub(" ", text[begin:end]).strip(" ")
    return f"{'…' if begin else ''}{shown}{'…' if end < len(text) else ''}"


def hits_in(text: str | None, query: str | None) -> list[tuple[int, int, int, str]]:
    """(search_start, source_start, source_end, preview_text) of every occurrence of a query in a text, both folded; none for nulls and queries of white space alone."""
    wanted = normalize_with_offsets(query)[0] if query else ""
    if not wanted or not text:
        return []
    folded, starts, ends = normalize_with_offsets(text)
    out, at = [], folded.find(wanted)
    while at >= 0:
        first, last = starts[at], ends[at + len(wanted) - 1]
        out.append((at, first, last, _preview(text, first, last)))
        at = folded.find(wanted, at + len(wanted))
    return out


def register(spark: SparkSession) -> None:
    """Makes ``exact_hits(text, query)`` a table function of SQL, for use in a lateral join: a row for each occurrence. Rows come and go in Arrow batches; functions that are handed the batches themselves can't be joined laterally."""

    @F.udtf(returnType=HITS, useArrow=True)
    class ExactHits:
        def eval(self, text: str, query: str):
            yield from hits_in(text, query)

    spark.udtf.register("exact_hits", ExactHits)
