"""Ranking and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright import limits

REQUEST = ["document_id", "request_id"]


def status_of(probability: Column) -> Column:
    """[D14] As an aggregate over a request's passages."""
    return F.when(F.bool_or(probability >= limits.MATCHED), "matched").when(F.bool_or(probability >= limits.UNCERTAIN), "uncertain").otherwise("no_match")


def best_first() -> list[Column]:
    """[F1] Probability, then score, then document order, which stands in for a stable sort."""
    return [F.desc("relevant_probability"), F.desc("score"), F.asc("doc_ordinal")]


def judge(segments: DataFrame, answers: DataFrame) -> DataFrame:
    """[C1] Passages (document_id, request_id, segment_id, doc_ordinal) with their answers' score, relevant_probability and confidence; null where none came."""
    flat = answers.select(*REQUEST, "segment_id", "score", F.col("probabilities")["2"].alias("relevant_probability"), "confidence")
    return segments.join(flat, [*REQUEST, "segment_id"], "left")


def classify(judged: DataFrame, answers: DataFrame) -> DataFrame:
    """[K13] (document_id, request_id, status, error_code, evaluated_segment_count): a search with a passage unjudged, or an answer too many, is an error, never ``no_match``."""
    came = answers.groupBy(*REQUEST).agg(F.count(F.lit(1)).alias("came"))
    sums = judged.groupBy(*REQUEST).agg(F.count(F.lit(1)).alias("sent"), F.count("relevant_probability").alias("met"), status_of(F.col("relevant_probability")).alias("s"))
    both = sums.join(came, REQUEST, "left")
    whole = (F.col("sent") == F.col("met")) & (F.col("sent") == F.coalesce("came", F.lit(0)))
    return both.select(*REQUEST, F.when(whole, F.col("s")).alias("status"), F.when(~whole, "incomplete_evaluation").alias("error_code"), F.col("met").alias("evaluated_segment_count"))


def top_results(judged: DataFrame, most: int = limits.MAX_RESULTS) -> DataFrame:
    """[F2, B26] The best ``most`` passages that match, with their rank; never padded with weaker ones. Plans as WindowGroupLimit."""
    w = Window.partitionBy(*REQUEST).orderBy(*best_first())
    return judged.where(F.col("relevant_probability") >= limits.MATCHED).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def provisional(judged: DataFrame, most: int = limits.MAX_RESULTS) -> DataFrame:
    """[I1, C4] After each batch, the best passages so far: (document_id, request_id, upto, segment_id, rank, evaluated) of judged passages with batch_no.

    A batch is cut to its own best, and a request's batches, as many as its passages allow, are one row: a fold in their order carries the best on.
    """
    key = F.struct((-F.col("relevant_probability")).alias("a"), (-F.col("score")).alias("b"), "doc_ordinal", "segment_id")
    matched = F.when(F.col("relevant_probability") >= limits.MATCHED, key)
    batch = judged.groupBy(*REQUEST, "batch_no").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list(matched)), 1, most).alias("best"))
    whole = batch.groupBy(*REQUEST).agg(F.array_sort(F.collect_list(F.struct("batch_no", "n", "best"))).alias("batches"))
    kind = batch.schema["best"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("evaluated"), F.array().cast(kind).alias("top"), F.array().cast(f"array<struct<upto: int, evaluated: bigint, top: {kind}>>").alias("out"))

    def step(acc, x):
        evaluated, top = acc["evaluated"] + x["n"], F.slice(F.array_sort(F.concat(acc["top"], x["best"])), 1, most)
        row = F.struct(x["batch_no"].cast("int").alias("upto"), evaluated.alias("evaluated"), top.alias("top"))
        return F.struct(evaluated.alias("evaluated"), top.alias("top"), F.concat(acc["out"], F.array(row)).alias("out"))

    rows = whole.select(*REQUEST, F.explode(F.aggregate("batches", start, step, lambda acc: acc["out"])).alias("r"))
    return rows.select(*REQUEST, "r.upto", "r.evaluated", F.posexplode("r.top").alias("k", "t")).select(*REQUEST, "upto", "t.segment_id", (F.col("k") + 1).alias("rank"), "evaluated")


def debug_order(segments: DataFrame, judged: DataFrame) -> DataFrame:
    """[F7, C10, E13] Adds position (document order) and shown (judged passages near or above the threshold first, the rest as in the document)."""
    numbered = segments.withColumn("position", F.row_number().over(Window.partitionBy(*REQUEST).orderBy("doc_ordinal")))
    both = numbered.join(judged.select(*REQUEST, "segment_id", "relevant_probability", "score"), [*REQUEST, "segment_id"], "left")
    near = F.coalesce(F.col("relevant_probability"), F.lit(-1.0)) >= limits.UNCERTAIN
    w = Window.partitionBy(*REQUEST).orderBy(near.desc(), F.when(near, -F.col("relevant_probability")), F.when(near, -F.coalesce("score", F.lit(0.0))), "position")
    return both.withColumn("shown", F.row_number().over(w))


def to_hits(results: DataFrame, segments: DataFrame) -> DataFrame:
    """[C2] Results with their passages, in rank order; ids that aren't the document's are dropped."""
    return segments.join(results.select(*REQUEST, "segment_id", "rank", "relevant_probability", "confidence"), [*REQUEST, "segment_id"], "inner")


def highlighted(results: DataFrame, segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """[C13] What to highlight for chosen (document_id, request_id, segment_id): the result if it is one, else the passage itself."""
    picked = chosen.join(segments.select(*REQUEST, "segment_id", F.col("ranges").alias("own")), [*REQUEST, "segment_id"], "left").join(results.select(*REQUEST, "segment_id", F.col("ranges").alias("hit")), [*REQUEST, "segment_id"], "left")
    return picked.select(*REQUEST, "segment_id", F.coalesce("hit", "own").alias("ranges"))


def reveal(hits: DataFrame, shown: int, selected: str | None = None) -> DataFrame:
    """The first ``shown`` hits by place, and the selected one wherever it is."""
    w = Window.partitionBy("document_id").orderBy("page_number", "search_start")
    return hits.withColumn("place", F.row_number().over(w)).where((F.col("place") <= shown) | (F.col("hit_key") == F.lit(selected)))
