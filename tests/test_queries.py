"""Queries against their SQL at the smallest scale. ``python tests/compare.py`` does all of them at any scale."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SLOW = ("q_contextual_blend", "q_context_multipliers", "q_evidence_sample", "q_candidate_blends")  # parts of q_model_contextual
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in SQL if n not in SLOW and n.startswith("q_")])
def test_same_rows_as_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQL[name], SF) is None


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
