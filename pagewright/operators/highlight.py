"""Highlight targets and emphasis, as data."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.characters import SPACE
from pagewright.operators.literals import longest

_SPLIT = re.compile(f"[{SPACE}、。,.!?！？]+")


def resolve_targets(hits: DataFrame, items: DataFrame, layers: DataFrame) -> DataFrame:
    """[K15, C9] (document_id, page_number, hit_key, failure, targets) of hits (…, ranges).

    ``layers`` (document_id, page_number, rendered, texts array<string>) is what was drawn, ``items`` what was read. A hit fails as a whole: layer_not_ready,
    element_count_mismatch, or content_mismatch. Ranges are clamped to their item, empty ones left out.
    """
    keys = ["document_id", "page_number"]
    read = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("item_index", "str"))).alias("read"))
    both = hits.join(layers, keys, "left").join(read, keys, "left")
    text = lambda r: F.try_element_at("read", r["item_index"] + 1)["str"]
    drawn = lambda r: F.try_element_at("texts", r["item_index"] + 1)
    wrong = F.exists("ranges", lambda r: text(r).isNull() | drawn(r).isNull() | (text(r) != drawn(r)))
    failure = (
        F.when(~F.coalesce("rendered", F.lit(False)), "layer_not_ready")
        .when(F.coalesce(F.size("texts") != F.size("read"), F.lit(True)), "element_count_mismatch")
        .when(F.coalesce(wrong, F.lit(True)), "content_mismatch")
    )

    def target(r):
        n = F.char_length(text(r))
        start = F.when(r["whole_item"], 0).otherwise(F.greatest(F.lit(0), F.least(r["start_offset"], n)))
        end = F.when(r["whole_item"], n).otherwise(F.greatest(start, F.least(r["end_offset"], n)))
        return F.struct(r["item_index"].alias("item_index"), text(r).alias("text"), start.alias("start_offset"), end.alias("end_offset"), r["whole_item"].alias("whole_item"))

    found = F.filter(F.transform("ranges", target), lambda t: (F.char_length(t["text"]) > 0) & ((t["start_offset"] < t["end_offset"]) | t["whole_item"]))
    return both.select(*keys, "hit_key", failure.alias("failure"), F.when(failure.isNull(), found).alias("targets"))


def apply_targets(resolved: DataFrame) -> DataFrame:
    """[K16] One row per target: what comes before the mark, the marked text, and what comes after."""
    rows = resolved.where("failure is null").select("document_id", "page_number", "hit_key", F.explode("targets").alias("t"))
    part = lambda a, b: F.col("t.text").substr(a + 1, b - a)
    start, end, n = F.col("t.start_offset"), F.col("t.end_offset"), F.char_length("t.text")
    return rows.select("document_id", "page_number", "hit_key", "t.item_index", part(F.lit(0), start).alias("before"), part(start, end).alias("marked"), part(end, n).alias("after"))


def emphasis(text: str, query: str) -> list[tuple[str, bool]]:
    """[K18, F8] A text in parts, those that are literally terms of the query marked; the earliest hit first, of those the longest."""
    terms = tuple(sorted({t.lower() for t in _SPLIT.split(query) if len(t.encode("utf-16-le")) >= 4}))
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: compare one by one
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    edges = [0, *(x for span in (longest(terms, low) if terms else ()) for x in span), len(text)]
    parts = [(text[a:b], bool(k % 2)) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
    return parts or [(text, False)]


def emphasis_spans(texts: DataFrame, query: str) -> DataFrame:
    """Adds spans array<struct<text, hit>> to a DataFrame with a column ``text``; Arrow batches, as no built-in finds many terms at once."""
    @F.pandas_udf(T.ArrayType(T.StructType.fromDDL("text string, hit boolean")))
    def spans(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else [{"text": a, "hit": b} for a, b in emphasis(t, query)])

    return texts.withColumn("spans", spans("text"))
