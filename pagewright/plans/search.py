"""Whole lifecycles: opening documents, exact search, relevance search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright import limits
from pagewright.operators import batches, exact_search, lines, rank, segments, validate
from pagewright.operators.scorers import Scorer
from pagewright.sources.items import page_ceiling
from pagewright.sources.storage import store


@dataclass
class Corpus:
    """What opening gives: pages of lines, passages in document order, the page index, limits that are exceeded, pages search can't reach."""

    pages: DataFrame
    segments: DataFrame
    index: DataFrame
    violations: DataFrame
    unsearched: DataFrame


#: What a document may have at most.
MOST = {"page_count": limits.MAX_PAGE_COUNT, "extracted_characters": limits.MAX_EXTRACTED_CHARACTERS, "segment_count": limits.MAX_SEGMENT_COUNT}


def ingest(items: DataFrame, rotations: DataFrame | None = None, most: dict[str, int] = MOST) -> Corpus:
    """[K19] Opens all documents of ``items``: one shuffle by page, then one by document for ordinals and totals. Pages and passages are stored as they are made, so that all searches read them and none makes them again.

    Documents over the page limit are refused before any line is built; pages after the character ceiling are left out; other limits only block relevance search.
    """
    counts = items.groupBy("document_id").agg(F.max("page_number").alias("page_count"))
    small = items.join(counts.where(F.col("page_count") <= most["page_count"]), "document_id", "left_semi")
    if rotations is not None:
        small = small.join(rotations.where("rotate % 180 <> 0").select("document_id", "page_number"), ["document_id", "page_number"], "left_anti")
    found = store(lines.page_lines(small), "pages")
    facts = lines.page_facts(small, found, rotations)
    read = page_ceiling(facts).where("extracted").select("document_id", "page_number")
    pages = lines.order_by_column(found.join(read, ["document_id", "page_number"], "left_semi"))
    passages = store(segments.number_segments(segments.build_segments(pages)), "passages")
    totals = counts.join(passages.groupBy("document_id").agg(F.sum(F.char_length("original_text")).alias("extracted_characters"), F.count(F.lit(1)).alias("segment_count")), "document_id", "left").na.fill(0)
    return Corpus(pages, passages, exact_search.page_index(pages), validate.limit_violations(totals, most), lines.unsearched_pages(facts))


def find(corpus: Corpus, query: str) -> DataFrame:
    """Exact search over all pages; for reading, order by document, page and place."""
    return exact_search.exact_search(corpus.index, query)


def relevance_batches(segments_: DataFrame, queries: DataFrame) -> DataFrame:
    """[K6] Batch rows (document_id, request_id, query, batch_no, place, evaluated, id, text, context_before, context_after) of queries (document_id, request_id, query)."""
    counts = segments_.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    packed = batches.pack_batches(counts, ["document_id"])
    named = segments_.select("document_id", "doc_ordinal", F.col("segment_id").alias("id"), F.col("original_text").alias("text"), "context_before", "context_after")
    return packed.join(named, ["document_id", "doc_ordinal"]).join(queries, "document_id")


def document_requests(segments_: DataFrame) -> DataFrame:
    """(document_id, segments_code, segment_bytes): what every request for a document shares: the first failure among its passages, as ``validate.segments_error`` has it, and their bytes as a JSON array. Texts are neither shuffled nor gathered."""
    s = F.struct(F.col("segment_id").alias("id"), F.col("original_text").alias("text"), "context_before", "context_after")
    rows = segments_.withColumn("s", s).select("document_id", "segment_id", "doc_ordinal", F.char_length("original_text").alias("chars"), F.octet_length(F.to_json("s")).cast("long").alias("bytes"), validate.segment_error(F.col("s"), F.lit(False)).alias("code"))
    repeated = F.row_number().over(Window.partitionBy("document_id", "segment_id").orderBy("doc_ordinal")) > 1
    coded = rows.withColumn("code", F.when(repeated & ~F.col("code").eqNullSafe("malformed_segment_id"), "duplicate_segment_id").otherwise(F.col("code")))
    n, first = F.count(F.lit(1)), F.min_by("code", F.when(F.col("code").isNotNull(), F.col("doc_ordinal")))
    code = F.when(n > limits.MAX_SEGMENT_COUNT, "too_many_segments").when(first.isNotNull(), first).when(F.sum("chars") > limits.MAX_EXTRACTED_CHARACTERS, "extracted_text_too_long")
    return coded.groupBy("document_id").agg(code.alias("segments_code"), (F.sum("bytes") + n + 1).alias("segment_bytes"))  # brackets, and commas between


def search(corpus: Corpus, queries: DataFrame, scorer: Scorer) -> tuple[DataFrame, DataFrame]:
    """[K20, A14] (responses, results) of relevance searches (document_id, request_id, query): a status or an error_code for every request, and the best passages with ranks.

    Every request passes the request validation, with its document's passages as its segments: a document without a passage is ``segments_empty``, one of too
    many ``too_many_segments``. What fails isn't sent. A request that no answer came for is ``incomplete_evaluation``. Ids name one request each.
    """
    facts = document_requests(corpus.segments)
    own = F.struct(F.col("document_id").cast("string").alias("document_id"), "request_id", "query")
    asked = queries.select("document_id", "request_id", "query").join(facts, "document_id", "left")
    asked = asked.withColumn("body_bytes", F.octet_length(F.to_json(own)) + F.coalesce("segment_bytes", F.lit(0)))
    known = asked.select(F.col("document_id").alias("doc"), F.col("document_id").cast("string").alias("document_id"), "request_id", "query", "segments_code", "segment_bytes", "body_bytes")
    code = F.coalesce(validate.head_error(), F.when(F.col("segment_bytes").isNull(), "segments_empty"), F.col("segments_code"))
    asked = store(known.withColumn("code", code).select(F.col("doc").alias("document_id"), "request_id", "query", "code"), "asked")  # passages are checked once, not for each use
    good = asked.where("code is null").select("document_id", "request_id", "query")
    answers = scorer.score(relevance_batches(corpus.segments, good))
    sent = corpus.segments.join(good.select("document_id", "request_id"), "document_id")
    judged = rank.judge(sent, answers)
    outcomes = rank.classify(judged, answers)
    refused = asked.where("code is not null").select("document_id", "request_id", F.lit(None).cast("string").alias("status"), F.col("code").alias("error_code"), F.lit(0).cast("long").alias("evaluated_segment_count"))
    came = good.select("document_id", "request_id").join(outcomes, ["document_id", "request_id"], "left")
    came = came.select("document_id", "request_id", "status", F.when(F.col("status").isNull(), F.coalesce("error_code", F.lit("incomplete_evaluation"))).alias("error_code"), F.coalesce("evaluated_segment_count", F.lit(0)).cast("long").alias("evaluated_segment_count"))
    complete = outcomes.where("error_code is null").select("document_id", "request_id")
    return came.union(refused), rank.top_results(judged.join(complete, ["document_id", "request_id"], "left_semi"))


def search_metrics(responses: DataFrame, estimates: DataFrame) -> DataFrame:
    """[A15] What may be logged of searches: (document_id, request_id, outcome, evaluated_segment_count, requests, tokens); never a query or a text.

    ``estimates`` has a row for each document: requests and tokens.
    """
    outcome = F.coalesce("status", "error_code")
    return responses.join(estimates, "document_id", "left").select("document_id", "request_id", outcome.alias("outcome"), "evaluated_segment_count", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
