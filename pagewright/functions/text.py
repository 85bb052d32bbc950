"""Column functions on text and numbers (SURVEY ids in brackets)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import patterns
from pagewright.functions.characters import COMBINING, SPACE, ZERO_WIDTH
from pagewright.limits import MIN_SEGMENT_CHARACTERS

_DROP = re.compile(f"[{SPACE}{ZERO_WIDTH}]+")
#: A character with the marks that compose with it, and what is dropped between them.
_CLUSTER = re.compile(f"([^{SPACE}{ZERO_WIDTH}])((?:[{SPACE}{ZERO_WIDTH}]*[{COMBINING}])*)")
_KEEP = re.compile(f"[^{SPACE}{ZERO_WIDTH}]+")
_ODD = re.compile(f"[{COMBINING}Σ]")


def _lower(text: str) -> str:
    """Lower case letter by letter: a capital sigma has one form, wherever it stands in a word."""
    return text.replace("Σ", "σ").lower()


def normalize_with_offsets(text: str) -> tuple[str, list[int], list[int]]:
    """[H2] Search form of a text and, for each of its characters, the source range [start, end) it came from.

    White space and zero-width characters go; a character and the marks that compose with it are folded together by
    NFKC and lower case; white space that folding made goes too.
    """
    if unicodedata.is_normalized("NFKC", text) and not _ODD.search(text):  # nothing to fold but case
        runs = [m.span() for m in _KEEP.finditer(text)]
        low = "".join([text[a:b] for a, b in runs]).lower()
        starts = [i for a, b in runs for i in range(a, b)]
        if len(low) == len(starts):
            return low, starts, [i + 1 for i in starts]
    clusters = [(_DROP.sub("", _lower(unicodedata.normalize("NFKC", _DROP.sub("", m[0])))), m.start(), m.end()) for m in _CLUSTER.finditer(text)]
    return "".join(c for c, _, _ in clusters), [a for c, a, _ in clusters for _ in c], [b for c, _, b in clusters for _ in c]


def _python_normalize():
    @F.pandas_udf(T.StringType())
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else normalize_with_offsets(t)[0])

    return folded


def is_ascii(text: Column) -> Column:
    return F.char_length(text) == F.octet_length(text)


def normalize_for_search(text: Column) -> Column:
    """[H1] Search form of a text. ASCII texts stay in the JVM; only others are sent to Python."""
    plain = F.lower(F.translate(text, "\t\n\x0b\f\r ", ""))
    return F.when(is_ascii(text), plain).otherwise(_python_normalize()(F.when(~is_ascii(text), text)))


def trim_space(text: Column) -> Column:
    """Trims ECMAScript white space at both ends."""
    return F.regexp_replace(text, f"\\A[{SPACE}]+|[{SPACE}]+\\z", "")


def tidy(text: Column) -> Column:
    """[H3] Collapses runs of blanks, tabs and no-break spaces, and trims."""
    return trim_space(F.regexp_replace(text, "[ \\t\\u00a0]+", " "))


def is_list_item(text: Column) -> Column:
    """[B6]"""
    return text.rlike(patterns.LIST_ITEM)


def is_provision(text: Column) -> Column:
    """[B7]"""
    return text.rlike(patterns.PROVISION)


def ends_sentence(text: Column) -> Column:
    """[B8]"""
    return text.rlike(patterns.SENTENCE_END)


def is_continuation(text: Column) -> Column:
    """[B9]"""
    return text.rlike(patterns.CONTINUATION)


def opens_next(text: Column) -> Column:
    """[B10] A short text that belongs with what follows."""
    return ~is_provision(text) & ~ends_sentence(text) & (F.char_length(text) < MIN_SEGMENT_CHARACTERS)


def closes_previous(text: Column) -> Column:
    """[B11] A short text that belongs with what comes before."""
    return ~is_provision(text) & ends_sentence(text) & (F.char_length(text) < MIN_SEGMENT_CHARACTERS)


def segment_id(page: Column, sequence: Column) -> Column:
    """[H6]"""
    return F.format_string("p%03d-s%03d", page, sequence)


def hit_key(page: Column, start: Column) -> Column:
    """[H7]"""
    return F.format_string("p%03d-o%06d", page, start)


def question_key(segment: Column) -> Column:
    """[H8] Only ids of the grammar have a key."""
    return F.when(segment.rlike(patterns.SEGMENT_ID), F.concat(F.lit("relevance_"), F.replace(segment, F.lit("-"), F.lit("_"))))


def segment_of_question(key: Column) -> Column:
    """[H8] The id that a question key stands for; null for anything else."""
    found = F.regexp_replace(F.regexp_replace(key, "\\Arelevance_", ""), "\\A(p[0-9]{3})_(s[0-9]{3})\\z", "$1-$2")
    return F.when(key.startswith("relevance_") & found.rlike(patterns.SEGMENT_ID), found)


def js_round(x: Column) -> Column:
    """[H21] Rounds halves up."""
    return F.floor(x + 0.5)


def percent(part: Column, whole: Column) -> Column:
    """[D23] Whole per cents, n/a without a whole."""
    return F.when(whole == 0, "n/a").otherwise(F.concat(js_round(100.0 * part / F.when(whole != 0, whole)).cast("string"), F.lit("%")))


def readable_size(size: Column) -> Column:
    """[H16]"""
    step = F.floor(F.log(1024.0, F.when(size > 0, size).cast("double"))).cast("int")
    names = F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")))
    return F.when(size == 0, "0 KB").otherwise(F.concat(F.floor(size / F.pow(F.lit(1024.0), step)).cast("string"), F.lit(" "), F.element_at(names, step + 1)))


def describe_pages(pages: Column, plural: str, singular: str) -> Column:
    """[H17] The words Page and Pages are fixed values."""
    return F.when(F.size(pages) == 1, F.concat(F.lit("Page "), pages[0].cast("string"), F.lit(f" {singular}."))).otherwise(F.concat(F.lit("Pages "), F.array_join(pages, ", "), F.lit(f" {plural}.")))


def empty_result_note(mode: Column, every_page_searched: Column) -> Column:
    """[H18] What an empty result means. The wording is a fixed value."""
    scope = F.when(every_page_searched, "the extracted text").otherwise("the text that could be searched")
    return F.when(mode == "exact", F.concat(F.lit("No matching text was found in "), scope, F.lit("."))).otherwise(F.concat(F.lit("No passage in "), scope, F.lit(" met the relevance threshold.")))


def verdict(probability: Column, matched: float, uncertain: float, names=("matched", "uncertain", "below threshold")) -> Column:
    """[B28, B29] Bands of a probability; the names ("confident", "unsure", "weak") give its tone."""
    return F.when(probability >= matched, names[0]).when(probability >= uncertain, names[1]).otherwise(names[2])


def is_finite(x: Column) -> Column:
    """[H25]"""
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def retry_after_ms(header: Column, now: Column) -> Column:
    """[H29] Milliseconds to wait by a header of seconds or an HTTP date; null if it is neither."""
    clean = F.trim(header)
    seconds = F.when(clean == "", 0.0).otherwise(clean.try_cast("double"))
    date = F.try_to_timestamp(F.substring_index(header, ", ", -1), F.lit("dd MMM yyyy HH:mm:ss z"))
    wait = (F.unix_millis(date) - F.unix_millis(now)).cast("double")
    return F.when(is_finite(seconds) & (seconds >= 0), seconds * 1000).otherwise(F.when(date.isNotNull(), F.greatest(F.lit(0.0), wait)))


def wait_seconds(ms: Column, longest_ms: int = 15_000) -> Column:
    """[H31]"""
    return F.least(F.greatest(F.lit(1), F.ceil(ms / 1000)), F.lit(-(-longest_ms // 1000))).cast("long")


def is_json_media_type(header: Column) -> Column:
    """[A8]"""
    return F.lower(trim_space(F.split(F.coalesce(header, F.lit("")), ";")[0])) == "application/json"


def declared_length_exceeds(header: Column, most: int) -> Column:
    """[A9] Malformed, negative and missing lengths don't exceed."""
    return F.coalesce(F.trim(header).try_cast("bigint") > most, F.lit(False))


def is_same_origin(site: Column, origin: Column, url: Column) -> Column:
    """[B24] By the fetch-site header if there is one, else by scheme, host and port of the origin."""

    def place(u: Column) -> Column:
        scheme, host = F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(u, F.lit("HOST")))
        port = F.regexp_extract(F.try_parse_url(u, F.lit("AUTHORITY")), ":([0-9]+)\\z", 1)
        usual = F.when(scheme == "http", "80").when(scheme == "https", "443").otherwise("")
        return F.concat_ws("|", scheme, host, F.when(port == "", usual).otherwise(port))

    valid = F.try_parse_url(origin, F.lit("HOST")).isNotNull()
    return F.when(site.isNotNull(), site.isin("same-origin", "none")).when(origin.isNull(), True).otherwise(valid & (place(origin) == place(url)))


def is_file_accepted(name: Column, kind: Column, accept: str) -> Column:
    """[A5] ``accept`` lists extensions, ``type/*`` wildcards and exact types; an empty list takes all."""
    wanted = [a.strip() for a in accept.split(",") if a.strip()]
    if not wanted:
        return F.lit(True)
    extension = F.concat(F.lit("."), F.lower(F.element_at(F.split(name, "\\."), -1)))
    out = F.lit(False)
    for a in wanted:
        out |= extension == a.lower() if a.startswith(".") else F.coalesce(kind.startswith(a[:-1]), F.lit(False)) if a.endswith("/*") else F.coalesce(kind == a, F.lit(False))
    return out
