"""Many literals at once, the table function, and medians of hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import sql
from pagewright.functions.statistics import weighted_lower_median
from pagewright.operators import exact_search, highlight, lines, literals
from pagewright.sources.testdata import items_of_documents


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(11)
    words = ["the", "and", "abab", "aa", "aaa", "ﬁx", "Σας", "日本語", "カ゛", "é", "x"]
    docs = spark.createDataFrame([(k, "\n".join(" ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(rng.randrange(0, 60)))) for k in range(25)], "doc_id long, text string")
    return exact_search.page_index(lines.page_lines(items_of_documents(docs))).cache()


QUERIES = ["the", "The and", "abab", "aba", "a a", "aa", "日本", "fix", "ガ", "σασ", "zzz", "\\E", ".", "ab", "THE", "x", "é"]


@pytest.mark.parametrize("most", [1000, 5])
def test_as_single_searches(spark, index, most):
    wanted = spark.createDataFrame([*enumerate(QUERIES), (90, " \n"), (91, None), (92, "the")], "literal_id int, query string")
    got = literals.search_literals(index, wanted, most=most).collect()
    want = []
    for k, query in [*enumerate(QUERIES), (92, "the")]:
        want += [(k, r.document_id, r.page_number, r.hit_key, r.search_start) for r in exact_search.exact_search(index, query).collect()]
    assert sorted(map(tuple, got)) == sorted(want)


def test_without_literals_or_pages(spark, index):
    none = spark.createDataFrame([], "literal_id int, query string")
    assert literals.search_literals(index, none).collect() == []
    some = spark.createDataFrame([(1, "the")], "literal_id int, query string")
    assert literals.search_literals(index.limit(0), some).collect() == []


def test_thousands_in_one_pass(spark, index):
    rng = random.Random(2)
    many = spark.createDataFrame([(k, "".join(rng.choices("abtheandx", k=4))) for k in range(4000)], "literal_id int, query string")
    found = literals.search_literals(index, many)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sum("MapInArrow" in line and "word#" in line for line in plan.split("\n")) == 1
    few = rng.sample(range(4000), 12)
    got = {(r.literal_id, r.document_id, r.search_start, r.page_number) for r in found.where(F.col("literal_id").isin(few)).collect()}
    asked = {r.literal_id: r.query for r in many.collect()}
    want = {(k, r.document_id, r.search_start, r.page_number) for k in few for r in exact_search.exact_search(index, asked[k]).collect()}
    assert got == want


def test_leftmost_longest():
    rng = random.Random(4)
    for _ in range(500):
        terms = {"".join(rng.choices("abc", k=rng.randrange(2, 5))) for _ in range(rng.randrange(1, 6))}
        text = "".join(rng.choices("abc", k=40))
        at, want = 0, []
        while hits := [(i, -len(t)) for t in terms if (i := text.find(t, at)) >= 0]:
            start, minus = min(hits)
            want.append((start, at := start - minus))
        assert list(literals.longest(tuple(sorted(terms)), text)) == want, (terms, text)
        shown = highlight.emphasis(text, " ".join(sorted(terms)))
        assert "".join(t for t, _ in shown) == text and [t for t, hit in shown if hit] == [text[a:b] for a, b in want]


def test_the_table_function_gives_the_search(spark, index):
    sql.register(spark)
    index.createOrReplaceTempView("pages_of_index")
    for query in ("the", "日本", "aa", "e"):
        got = spark.sql(f"select p.document_id, p.page_number, h.search_start, h.preview_text from pages_of_index p, lateral exact_hits(p.original_text, '{query}') h").collect()
        want = exact_search.exact_search(index, query).select("document_id", "page_number", "search_start", "preview_text").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), query
    assert spark.sql("select * from pages_of_index p, lateral exact_hits(p.original_text, ' ') h").count() == 0


def test_medians_of_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot", rng.randrange(5000) / 4, rng.randrange(0, 4)) for _ in range(6000)]
    rows += [(rng.choice("abc"), float(rng.randrange(9)), 1) for _ in range(200)] + [(None, 2.0, 3), (None, 1.0, 1), ("zero", 1.0, 0), ("one", 7.0, 2), ("same", 3.0, 1), ("same", 3.0, 5)]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    got = {r.k: r.m for r in weighted_lower_median(df, ["k"], "v", "w", "m").collect()}
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((v, w) for k, v, w in rows if k == key and w > 0)
        upto, all_ = 0, sum(w for _, w in own)
        for v, w in own:
            upto += w
            if upto * 2 >= all_:
                want[key] = v
                break
    assert got == want


def test_a_key_with_all_rows(spark):
    df = spark.range(40_000).selectExpr("'hot' as k", "id as v", "1 as w")
    assert weighted_lower_median(df, ["k"], "v", "w", "m").first().m == 19_999
