"""Plans that the code counts on."""

import pytest
from pyspark.sql import functions as F

from pagewright.plans import catalogue, search


def explained(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_top_results_are_limited_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in explained(catalogue.rank_top3(spark, sf_dir))


@pytest.mark.parametrize(("name", "columns"), [("exact_hit_counts", "doc_id:bigint,text:string"), ("answer_validation", "doc_id:bigint"), ("rate_limit", "event_id:bigint,ts:timestamp_ntz,user_id:bigint"), ("media_type", "page_id:bigint,html:string")])
def test_scans_read_only_what_is_asked_for(spark, sf_dir, name, columns):
    assert f"ReadSchema: struct<{columns}>" in explained(catalogue.queries()[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["answer_validation", "error_replies", "admission_gates", "media_type", "settled_panels", "file_intake"])
def test_row_wise_operators_do_not_shuffle_for_keys(spark, sf_dir, name):
    assert "hashpartitioning" not in explained(catalogue.queries()[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["pack_batches", "multi_column_pages", "request_validation", "stream_validator", "debug_order", "eval_rates", "unmatched_answers"])
def test_relational_operators_run_no_python_on_rows(spark, sf_dir, name):
    plan = explained(catalogue.queries()[name](spark, sf_dir))
    assert "EvalPython" not in plan and ("MapInArrow" in plan) == (name == "multi_column_pages")


def test_a_passage_needs_one_shuffle_by_page(spark, sf_dir):
    plan = explained(catalogue.segment_context(spark, sf_dir))
    assert plan.count("hashpartitioning(document_id") == 1 and "SortMergeJoin" not in plan


def test_pages_are_filtered_before_they_are_indexed(spark, sf_dir):
    plan = explained(catalogue.exact_preview(spark, sf_dir))
    steps = plan.split("\n(")  # operators by number, the scan first
    searched = next(k for k, step in enumerate(steps) if "Filter" in step.split("\n")[0] and "ontains(" in step)
    assert any("ArrowEvalPython" in step.split("\n")[0] for step in steps[searched + 1 :])


def test_running_bests_need_no_join(spark, sf_dir):
    assert "Join" not in explained(catalogue.provisional_topk(spark, sf_dir))


def test_metrics_hold_no_text(spark):
    responses = spark.createDataFrame([(1, "r", "matched", None, 3), (2, "s", None, "query_empty", 0)], "document_id long, request_id string, status string, error_code string, evaluated_segment_count long")
    estimates = spark.createDataFrame([(1, 1, 900)], "document_id long, requests long, tokens long")
    got = search.search_metrics(responses, estimates).orderBy("document_id").collect()
    assert [tuple(r) for r in got] == [(1, "r", "matched", 3, 1, 900), (2, "s", "query_empty", 0, 0, 0)]


def test_searches_read_stored_pages_and_passages(spark, sf_dir):
    """Opening builds pages and passages once; no search builds them again."""
    for name in ("search_responses", "search_results"):
        plan = explained(catalogue.queries()[name](spark, sf_dir))
        assert "MapInArrow" not in plan and "MapInPandas" not in plan


def test_passages_are_checked_once(spark, sf_dir):
    """What was checked is stored, so that no use of it gathers or renders passages again."""
    for name in ("search_responses", "search_results"):
        plan = explained(catalogue.queries()[name](spark, sf_dir))
        assert "collect_list" not in plan and "to_json" not in plan and "StructsToJson" not in plan


def test_checked_passages_are_those_of_the_request_validation(spark):
    """The first failure and the bytes are what the gathered segments have, and the plan gathers none."""
    from pagewright.operators import validate

    x = "x" * 801
    docs = {
        1: [("p001-s001", "a", None, "b\u00e9"), ("p001-s002", "b\u00e9", "a", None)],
        2: [("p001-s001", "a", None, None), ("p1", "b", None, None), ("p001-s001", "c", None, None)],
        3: [("p001-s001", " \u3000\ufeff", None, None), ("p001-s001", "c", None, None)],
        4: [("p001-s001", "a", None, None), ("p001-s001", x, None, None)],
        5: [("p001-s001", "a", None, x)],
        6: [("p001-s001", None, None, None)],
        7: [(f"p001-s{k:03d}", "z" * 800, None, None) for k in range(1, 252)],
        8: [("p1", "a", None, None), ("p1", "b", None, None)],
        9: [(f"p{k // 999 + 1:03d}-s{k % 999 + 1:03d}", "a", None, None) for k in range(2001)],
    }
    rows = spark.createDataFrame([(d, k, *s) for d, own in docs.items() for k, s in enumerate(own, 1)], "document_id long, doc_ordinal int, segment_id string, original_text string, context_before string, context_after string")
    got = search.document_requests(rows)
    assert "collect_list" not in explained(got)
    one = F.struct("doc_ordinal", F.struct(F.col("segment_id").alias("id"), F.col("original_text").alias("text"), "context_before", "context_after").alias("s"))
    lists = rows.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("segments"))
    want = lists.select("document_id", validate.segments_error().alias("code"), F.octet_length(F.to_json("segments")).alias("bytes"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert dict(got.select("document_id", "segments_code").collect()) == {1: None, 2: "malformed_segment_id", 3: "segment_text_empty", 4: "duplicate_segment_id", 5: "segment_text_too_long", 6: "invalid_request", 7: "extracted_text_too_long", 8: "malformed_segment_id", 9: "too_many_segments"}


def test_values_are_made_by_column():
    import pyarrow as pa

    from pagewright.functions.arrow import python_rows

    batch = pa.RecordBatch.from_pylist([{"a": None, "b": [{"x": 1.5, "y": [None, 2]}, None], "c": "s"}, {"a": 3, "b": None, "c": None}, {"a": 4, "b": [], "c": ""}, {"a": 5, "b": [{"x": None, "y": None}], "c": "\u00e9"}])
    for part in (batch, batch.slice(1), batch.slice(1, 2), batch.slice(0, 0)):
        assert python_rows(part) == part.to_pylist()


def test_rate_limits_read_events_once(spark, sf_dir):
    assert explained(catalogue.rate_limit(spark, sf_dir)).count("\nLocation:") == 1


def test_words_are_shuffled_as_lines(spark, sf_dir):
    """Pages get their lines by one shuffle, before they are cut into words."""
    plan = explained(catalogue.words_to_lines(spark, sf_dir))
    assert plan.count("hashpartitioning(document_id") == 1


def test_words_are_items_in_workers_only(spark, sf_dir):
    """Spark has lines and what comes of them: no row, no window and no list for words."""
    plan = explained(catalogue.words_to_lines(spark, sf_dir))
    assert "Window" not in plan and "transform" not in plan and "pieces" not in plan and "Aggregate" not in plan
