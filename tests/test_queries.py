"""Every registered query: against its SQL form where it has one, else that it gives rows (their values: test_operators)."""

import pytest
from compare import assert_same

import __spark_entry__
from tessera.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "doc_id", "kind", "rank", "bm25", "score", "snippet"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
