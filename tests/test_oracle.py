"""A representative slice of the correctness gate, inside the test suite (sf0.001)."""

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL
from .oracle_harness import compare, duck

FAST = ["hash_id", "normalise_title", "region", "country", "contract", "extract_skills", "salary_parse",
        "dedup_hash", "dedup_title_link", "it_filter", "source_count", "strip_html", "cosine_topk",
        "salary_impute_orders", "linkedin_join", "num_coerce"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb(spark, con, name):
    info = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert info["ok"], info
