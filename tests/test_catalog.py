import importlib.util

import pytest

import __spark_entry__ as entry
from ozalid.plans import catalog
from tests import oracle


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, sf, name):
    oracle.check(spark, sf, catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["label", "total", "correct_rows", "accuracy"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if importlib.util.find_spec("ozalid.llm") is None:
        assert not [n for n in entry.queries() if n.startswith("p1_")]
