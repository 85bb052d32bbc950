import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.functions.characters import is_cjk, is_space, strip


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("あｶ ﾞい", ("あガい", [0, 1, 4], [1, 4, 5])),
        ("ＡＢ　c", ("abc", [0, 1, 3], [1, 2, 4])),
        ("①", ("1", [0], [1])),
        ("㌔ x", ("キロx", [0, 0, 2], [1, 1, 3])),
        ("か​゙", ("が", [0], [3])),
        ("ΑΣ", ("ας".replace("ς", "σ"), [0, 1], [1, 2])),
        ("e\u0301", ("e\u0301", [0, 1], [1, 2])),
        ("🙂 A", ("🙂a", [0, 2], [1, 3])),
        ("", ("", [], [])),
        ("  ﻿\t", ("", [], [])),
        ("´", ("́", [0], [1])),
    ],
)
def test_normalize_with_offsets(text, want):
    assert tx.normalize_with_offsets(text) == want


def test_normalized_column_equals_the_function(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \t　​ｶﾞ①é゙한漢ﬁΣ\x1c\x85") for _ in range(rng.randrange(12))) for _ in range(200)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalize_for_search(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r.n == (None if r.t is None else tx.normalize_with_offsets(r.t)[0])


def test_space_and_cjk():
    assert all(map(is_space, "\t\n\x0b\f\r  　﻿ ")) and not any(map(is_space, "\x1c\x85​a"))
    assert all(map(is_cjk, "漢あア・ー「Ａｶ々〆𠀀")) and not any(map(is_cjk, "aé1-한"))
    assert strip("﻿　 x\x85 ") == "x\x85"


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        (tx.is_list_item, "  (1) x", True),
        (tx.is_list_item, "第十二条 x", True),
        (tx.is_list_item, "第2章", True),
        (tx.is_list_item, "12. x", True),
        (tx.is_list_item, "x 1.", False),
        (tx.is_provision, "第2章", False),
        (tx.is_provision, "4. Proof", False),
        (tx.is_provision, "① a", True),
        (tx.ends_sentence, "x。　", True),
        (tx.ends_sentence, "x.\n", True),
        (tx.ends_sentence, "x. y", False),
        (tx.is_continuation, " However, it", True),
        (tx.is_continuation, "ただし、", True),
        (tx.is_continuation, "the however", False),
        (tx.opens_next, "Short title", True),
        (tx.opens_next, "第5条　返金不可", False),
        (tx.closes_previous, "Done.", True),
    ],
)
def test_line_predicates(spark, name, text, want):
    assert one(spark, name(F.col("t")), t=("string", text)) is want


@pytest.mark.parametrize(("size", "want"), [(0, "0 KB"), (1, "1 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1 KB"), (5 << 20, "5 MB")])
def test_readable_size(spark, size, want):
    assert one(spark, tx.readable_size(F.col("s")), s=("long", size)) == want


def test_ids_and_keys(spark):
    assert one(spark, tx.segment_id(F.col("p"), F.lit(1234)), p=("int", 7)) == "p007-s1234"
    assert one(spark, tx.hit_key(F.col("p"), F.lit(5)), p=("int", 7)) == "p007-o000005"
    assert one(spark, tx.question_key(F.col("s")), s=("string", "p001-s002")) == "relevance_p001_s002"
    assert one(spark, tx.question_key(F.col("s")), s=("string", "p1-s2")) is None
    assert one(spark, tx.segment_of_question(F.col("s")), s=("string", "relevance_p001_s002")) == "p001-s002"
    assert one(spark, tx.segment_of_question(F.col("s")), s=("string", "p001_s002")) is None


@pytest.mark.parametrize(("header", "want"), [("3", 3000.0), (" 0.5 ", 500.0), ("-1", None), ("soon", None), (None, None), ("Wed, 21 Oct 2015 07:28:00 GMT", 60000.0)])
def test_retry_after(spark, header, want):
    from pagewright.operators.scorers import parse_retry_after

    assert one(spark, tx.retry_after_ms(F.col("h"), F.timestamp_millis(F.lit(1445412420000))), h=("string", header)) == want
    assert parse_retry_after(header, 1445412420000) == want


@pytest.mark.parametrize(
    ("site", "origin", "want"),
    [("same-origin", "https://x.y", True), ("none", None, True), ("cross-site", None, False), (None, None, True), (None, "https://a.b", True), (None, "https://a.b:443", True), (None, "http://a.b", False), (None, "https://a.b:8443", False), (None, "null", False)],
)
def test_same_origin(spark, site, origin, want):
    assert one(spark, tx.is_same_origin(F.col("s"), F.col("o"), F.lit("https://a.b/p?q")), s=("string", site), o=("string", origin)) is want


def test_rounding_percent_and_wording(spark):
    assert one(spark, tx.js_round(F.col("x")), x=("double", -2.5)) == -2
    assert one(spark, tx.percent(F.col("a"), F.lit(0)), a=("int", 1)) == "n/a"
    assert one(spark, tx.percent(F.col("a"), F.lit(8)), a=("int", 1)) == "13%"
    assert one(spark, tx.describe_pages(F.col("p"), "are out", "is out"), p=("array<int>", [3])) == "Page 3 is out."
    assert one(spark, tx.describe_pages(F.col("p"), "are out", "is out"), p=("array<int>", [3, 4])) == "Pages 3, 4 are out."
    assert one(spark, tx.empty_result_note(F.col("m"), F.lit(True)), m=("string", "exact")) == "No matching text was found in the extracted text."
    assert one(spark, tx.empty_result_note(F.col("m"), F.lit(False)), m=("string", "exact")) == "No matching text was found in the text that could be searched."
    assert one(spark, tx.empty_result_note(F.col("m"), F.lit(False)), m=("string", "meaning")) == "No passage in the text that could be searched met the relevance threshold."
    assert one(spark, tx.tidy(F.col("t")), t=("string", "　a \t b\n")) == "a b"


def test_weighted_lower_median(spark):
    from pagewright.functions.statistics import weighted_lower_median

    rows = [(1, 8.65, 10), (1, 10.09, 90), (2, 1.0, 1), (2, 2.0, 1), (3, 5.0, 0)]
    df = spark.createDataFrame(rows, "k int, v double, w long")
    assert {r.k: r.m for r in weighted_lower_median(df, ["k"], "v", "w", "m").collect()} == {1: 10.09, 2: 1.0}
