"""Search-quality evaluation."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.characters import SPACE, ZERO_WIDTH
from pagewright.functions.text import percent

_GONE = re.compile(f"[{SPACE}{ZERO_WIDTH}]")


def evaluation_form(text: str) -> str:
    """[K24] The whole text folded at once, then without white space and zero-width characters; not the search form of H1."""
    return _GONE.sub("", _GONE.sub(lambda m: m[0] if m[0].isspace() else "", unicodedata.normalize("NFKC", text)).lower())


def fold_for_evaluation(text: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else evaluation_form(t))

    return fold(text)


def judge_cases(cases: DataFrame) -> DataFrame:
    """[C12] Adds found and passed to cases (category, kind, expected, snippet, outcome, status, top3 array<string>).

    ``kind`` is top3_contains or status_not, ``outcome`` final or an error. ``snippet`` and ``top3`` are in evaluation form. A case without a final outcome is a provider error and neither passes nor counts in a rate.
    """
    final = F.col("outcome") == "final"
    found = F.exists("top3", lambda t: F.contains(t, F.col("snippet")))
    held = F.when(F.col("kind") == "top3_contains", F.coalesce(found, F.lit(False))).otherwise(F.col("status") != F.col("expected"))
    return cases.withColumn("found", final & F.coalesce(found, F.lit(False))).withColumn("passed", F.coalesce(final & held, F.lit(False)))


def rates(judged: DataFrame) -> DataFrame:
    """[D22, D23] One row: counts of misses, top-3 hits, false positives and provider errors over what each is taken from, with whole per cents. A miss is no_match alone, not uncertain."""
    final = F.col("outcome") == "final"
    asked = final & (F.col("kind") == "top3_contains")
    absent = final & (F.col("kind") == "status_not") & (F.col("expected") == "matched")
    sums = judged.agg(
        F.count_if(asked).alias("answerable"),
        F.count_if(asked & (F.col("status") == "no_match")).alias("missed"),
        F.count_if(asked & F.col("found")).alias("top_three"),
        F.count_if(absent).alias("unanswerable"),
        F.count_if(absent & (F.col("status") == "matched")).alias("false_positives"),
        F.count_if(~final).alias("provider_errors"),
        F.count(F.lit(1)).alias("cases"),
    )
    shares = {"miss_rate": ("missed", "answerable"), "top_three_rate": ("top_three", "answerable"), "false_positive_rate": ("false_positives", "unanswerable"), "error_rate": ("provider_errors", "cases")}
    return sums.select("*", *[percent(F.col(a), F.col(b)).alias(name) for name, (a, b) in shares.items()])


def tally(judged: DataFrame) -> DataFrame:
    """[D22] passed and total by category."""
    return judged.groupBy("category").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))


def terminal_of_body(bodies: DataFrame) -> DataFrame:
    """[K21] (id, kind, value) of the first terminal line of each NDJSON body (id, body): final with its status, error with its code; else unreadable."""
    lines = bodies.select("id", F.posexplode(F.split("body", "\n")).alias("k", "line"))
    m = F.from_json("line", "type string, status string, error struct<code: string>")
    ends = F.when((m["type"] == "final") & m["status"].isNotNull(), F.struct(F.lit("final").alias("kind"), m["status"].alias("value"))).when(m["type"] == "error", F.struct(F.lit("error").alias("kind"), F.coalesce(m["error"]["code"], F.lit("unknown")).alias("value")))
    first = lines.select("id", "k", ends.alias("e")).groupBy("id").agg(F.min_by("e", F.when(F.col("e").isNotNull(), F.col("k"))).alias("e"))
    return first.select("id", F.coalesce("e.kind", F.lit("unreadable")).alias("kind"), F.coalesce("e.value", F.lit("no_terminal_line")).alias("value"))


#: What a panel says and what it stands for, in the order in which the wording is looked for. Fixed values.
PANEL_WORDING = (
    ("The search could not be completed", "error", "stream_error"),
    ("came close to the relevance threshold", "final", "uncertain"),
    ("met the relevance threshold|No matching text was found", "final", "no_match"),
    (r"[0-9]+ results?\b", "final", "matched"),
)
#: Codes of HTTP statuses that have one of their own. Fixed values.
PANEL_STATUS = {429: "rate_limited", 503: "capacity_exhausted"}
#: What a panel says while its order isn't final. Fixed values.
PROVISIONAL_WORDING = "passages judged|may still change"


def outcome_of_panel(text: Column, http_status: Column) -> Column:
    """[K22] struct<kind, value> of a settled panel: the HTTP status first, then what the panel says."""
    said = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    codes = F.create_map(*[F.lit(x) for pair in PANEL_STATUS.items() for x in pair])
    failed = said("error", F.coalesce(codes[http_status], F.concat(F.lit("http_"), http_status.cast("string"))))
    rules = [F.when(text.rlike(pattern), said(kind, F.lit(value))) for pattern, kind, value in PANEL_WORDING]
    return F.coalesce(F.when(http_status != 200, failed), *rules, said("unreadable", F.lit("no_verdict_on_screen")))


def has_settled(text: Column) -> Column:
    """[K23] A verdict stands and nothing says that it is provisional."""
    return ~text.rlike(PROVISIONAL_WORDING) & text.rlike("|".join(pattern for pattern, _, value in PANEL_WORDING if value != "uncertain"))
