"""The registry: every query runs and has a stable schema, also without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from pagewright.plans import catalogue, oracles

ROOT = Path(__spark_entry__.__file__).parent


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["document_id", "page_number", "hit_key", "search_start", "n_ranges"] and found.count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_queries_run(spark, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_oracles_name_queries():
    assert set(oracles.oracle_sql()) <= set(catalogue.queries())


def test_import_without_the_corpus_operators():
    code = "import sys; sys.modules['pagewright.llm'] = None; import __spark_entry__ as e; assert 'exact_hits' in e.queries() and not any(q.startswith('op') for q in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
