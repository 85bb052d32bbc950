"""Many literal searches in one pass."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.arrow import bounded
from pagewright.functions.text import normalize_for_search
from pagewright.operators.exact_search import hit_key

#: Literals that are searched for in one pass, and their characters. More are searched for in further passes.
MOST_LITERALS = 100_000
MOST_CHARACTERS = 16 << 20


@lru_cache(maxsize=4)
def automaton(words: tuple[str, ...]):
    """An Aho-Corasick automaton of distinct words; a process builds it once."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, word in enumerate(words):
        made.add_word(word, (k, len(word)))
    made.make_automaton()
    return made


def occurrences(words: tuple[str, ...], text: str):
    """(word's number, start) of all words in ``text``, as if each were searched for by itself: from the left, without overlaps of its own."""
    free: dict[int, int] = {}
    for last, (k, size) in automaton(words).iter(text):
        if last + 1 - size >= free.get(k, 0):
            free[k] = last + 1
            yield k, last + 1 - size


def longest(words: tuple[str, ...], text: str):
    """(start, end) of the words in ``text``: the leftmost first, of those the longest, and on behind it."""
    free = 0
    for start, minus in sorted((last + 1 - size, -size) for last, (_, size) in automaton(words).iter(text)):
        if start >= free:
            free = start - minus
            yield start, free


def _passes(folded: DataFrame, most: int, characters: int) -> int:
    n, size = folded.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("word")), F.lit(0))).first()
    return max(1, -(-n // most), -(-size // characters))


def search_literals(index: DataFrame, literals: DataFrame, most: int = MOST_LITERALS, characters: int = MOST_CHARACTERS) -> DataFrame:
    """(literal_id, document_id, page_number, hit_key, search_start): what ``exact_search`` finds for each of ``literals`` (literal_id, query) in ``index`` (document_id, page_number, search_text).

    Literals are folded as the pages are, those of white space alone are none, and equal ones are searched for once. A pass reads every page once, whatever the number of its literals;
    it takes at most about ``most`` of them and ``characters`` of theirs, and those that are more take further passes. Hits meet their literals' ids afterwards.
    """
    import pyarrow as pa

    folded = literals.select("literal_id", normalize_for_search(F.col("query")).alias("word")).where("word <> ''")
    distinct = folded.select("word").distinct()
    passes = _passes(distinct, most, characters)
    kinds = {c: index.schema[c].dataType.simpleString() for c in ("document_id", "page_number")}
    pages = index.select(*kinds, "search_text")

    def found(words: tuple[str, ...]) -> DataFrame:
        def run(batches):
            import numpy as np

            for batch in bounded(batches, most=1 << 20):
                rows = [(row, k, start) for row, text in enumerate(batch.column(2)) if text.is_valid for k, start in occurrences(words, text.as_py())]
                row, k, start = np.array(rows, np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([pa.array([words[n] for n in k], pa.string()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(start, pa.int32())], ["word", "document_id", "page_number", "search_start"])

        return pages.mapInArrow(run, f"word string, document_id {kinds['document_id']}, page_number {kinds['page_number']}, search_start int")

    parts = []
    for n in range(passes):
        words = tuple(sorted(r.word for r in distinct.where(F.pmod(F.xxhash64("word"), F.lit(passes)) == n).collect()))
        parts += [found(words)] if words else []
    hits = reduce(DataFrame.union, parts) if parts else pages.limit(0).select(F.lit("").alias("word"), *kinds, F.lit(0).alias("search_start"))
    return hits.join(folded, "word").select("literal_id", "document_id", "page_number", hit_key(F.col("page_number"), F.col("search_start")).alias("hit_key"), "search_start")
