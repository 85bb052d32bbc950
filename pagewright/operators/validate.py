"""Validation of requests, answers and records: the first failure wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import limits
from pagewright.functions import patterns
from pagewright.functions.characters import SPACE
from pagewright.functions.text import is_finite, trim_space

RECORD_FIELDS = ("segment_id", "score", "relevant_probability", "confidence")


def head_error(most_body: int = limits.MAX_REQUEST_BODY_BYTES) -> Column:
    """[B13] The first failure of a request before its segments are looked at: of (body_bytes, document_id, request_id, query)."""
    named = lambda c: F.coalesce(F.col(c).rlike(patterns.IDENTIFIER), F.lit(False))
    return (
        F.when(F.col("body_bytes") > most_body, "request_body_too_large")
        .when(~named("document_id") | ~named("request_id") | F.col("query").isNull(), "invalid_request")
        .when(trim_space(F.col("query")) == "", "query_empty")
        .when(F.char_length("query") > limits.MAX_QUERY_CHARACTERS, "query_too_long")
    )


def segment_error(s: Column, repeated: Column) -> Column:
    """[B13] The first failure of one segment; ``repeated`` says whether an earlier one has its id."""
    long = limits.MAX_SEGMENT_CHARACTERS
    return (
        F.when(s.isNull(), "invalid_request")
        .when(s["id"].isNull() | ~s["id"].rlike(patterns.SEGMENT_ID), "malformed_segment_id")
        .when(repeated, "duplicate_segment_id")
        .when(s["text"].isNull(), "invalid_request")
        .when(~s["text"].rlike(f"[^{SPACE}]"), "segment_text_empty")
        .when((F.char_length(s["text"]) > long) | (F.coalesce(F.char_length(s["context_before"]), F.lit(0)) > long) | (F.coalesce(F.char_length(s["context_after"]), F.lit(0)) > long), "segment_text_too_long")
    )


def segments_error(most_characters: int = limits.MAX_EXTRACTED_CHARACTERS) -> Column:
    """[B13] The first failure among ``segments``: their number, then the first bad one in array order, then their summed text."""
    ids = F.transform("segments", lambda s: s["id"])
    bad = F.filter(F.transform("segments", lambda s, k: segment_error(s, F.array_position(ids, s["id"]) <= k)), lambda c: c.isNotNull())
    total = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.coalesce(F.char_length(s["text"]), F.lit(0)))
    return (
        F.when(F.col("segments").isNull(), "invalid_request")
        .when(F.size("segments") == 0, "segments_empty")
        .when(F.size("segments") > limits.MAX_SEGMENT_COUNT, "too_many_segments")
        .when(F.size(bad) > 0, F.try_element_at(bad, F.lit(1)))
        .when(total > most_characters, "extracted_text_too_long")
    )


def request_error(most_body: int = limits.MAX_REQUEST_BODY_BYTES, most_characters: int = limits.MAX_EXTRACTED_CHARACTERS) -> Column:
    """[B13] The first failure's code of a request (body_bytes, document_id, request_id, query, segments), null if there is none.

    The order is that of the columns above. A field of a wrong type is null once it is typed, so null stands for that.
    """
    return F.coalesce(head_error(most_body), segments_error(most_characters))


def is_valid_answer(kind: Column, score: Column, confidence: Column, probabilities: Column) -> Column:
    """[B14] Type, ranges, exactly the levels 0, 1 and 2, and probabilities that sum to 1 within the tolerance."""
    values = F.map_values(probabilities)
    sound = F.coalesce(F.forall(values, lambda p: is_finite(p) & p.between(0, 1)), F.lit(False))
    levels = F.coalesce(F.array_sort(F.map_keys(probabilities)) == F.array(F.lit("0"), F.lit("1"), F.lit("2")), F.lit(False))
    total = F.aggregate(values, F.lit(0.0), lambda s, p: s + p)
    ranges = is_finite(score) & score.between(0, 2) & is_finite(confidence) & confidence.between(0, 1)
    summed = F.coalesce(F.abs(total - 1) <= limits.PROBABILITY_SUM_TOLERANCE, F.lit(False))
    return F.coalesce(kind == "score", F.lit(False)) & F.coalesce(ranges, F.lit(False)) & levels & sound & summed


def is_valid_record(record: Column, sent: Column) -> Column:
    """[B17] A judged passage: an id that was sent, a finite score and two probabilities."""
    share = lambda p: is_finite(p) & p.between(0, 1)
    return F.coalesce(F.array_contains(sent, record["segment_id"]) & is_finite(record["score"]) & share(record["relevant_probability"]) & share(record["confidence"]), F.lit(False))


def are_valid_records(records: Column, sent: Column) -> Column:
    """[B18] All or nothing; a missing array is malformed."""
    return F.coalesce(F.forall(records, lambda r: is_valid_record(r, sent)), F.lit(False))


def is_error_code(code: Column) -> Column:
    """[B19]"""
    return F.coalesce(code.isin([name for name, *_ in limits.ERRORS]), F.lit(False))


def is_error_reply(error: Column) -> Column:
    """[B20]"""
    return error.isNotNull() & is_error_code(error["code"]) & error["message"].isNotNull()


def unmatched(expected: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """[C5, G5] ``keys`` of what only one side has, with ``problem`` "missing" or "unexpected"; no rows if the sets are equal."""
    missing = expected.select(*keys).join(answers.select(*keys), keys, "left_anti").withColumn("problem", F.lit("missing"))
    extra = answers.select(*keys).join(expected.select(*keys), keys, "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.union(extra)


def limit_violations(totals: DataFrame, most: dict[str, int]) -> DataFrame:
    """[B21-B23, G6] (document_id, kind, actual, limit, message) of totals (document_id and a long column for each kind in ``most``)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("actual"), F.lit(n).cast("long").alias("limit")) for k, n in most.items()])
    found = totals.select("document_id", F.explode(pairs).alias("v")).select("document_id", "v.*").where("actual > limit")
    return found.withColumn("message", describe_violation(F.col("kind"), F.col("actual"), F.col("limit")))


def describe_violation(kind: Column, actual: Column, limit: Column) -> Column:
    """[B23] The wording of the four messages is a fixed value."""
    mega = lambda x: x / F.lit(1024.0 * 1024.0)
    return (
        F.when(kind == "file_size", F.concat(F.lit("This PDF is "), F.call_function("format_number", mega(actual), F.lit("0.0")), F.lit(" MB. The limit is "), F.call_function("format_number", mega(limit), F.lit("0.###")), F.lit(" MB.")))
        .when(kind == "page_count", F.concat(F.lit("This PDF has "), actual.cast("string"), F.lit(" pages. The limit is "), limit.cast("string"), F.lit(".")))
        .when(kind == "extracted_characters", F.concat(F.lit("This PDF contains "), F.format_number(actual, 0), F.lit(" extracted characters. The limit is "), F.format_number(limit, 0), F.lit(".")))
        .when(kind == "segment_count", F.concat(F.lit("This PDF produced "), actual.cast("string"), F.lit(" searchable segments. The limit is "), limit.cast("string"), F.lit(".")))
    )
