import pytest

from ozalid.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, sf, name):
    oracle.check(spark, sf, queries.QUERIES[name], queries.ORACLE[name])


COLUMNS = {
    "p1_found": ["query_id", "field"], "p2_found": ["plan_id", "field", "category"], "p3_found": ["question_id_1", "question_id_2"], "p4_found": ["question_id", "group_id"],
    "p5_found": ["question_id", "field", "term_id"], "p7_ids": ["doc_id", "ids"], "p8_found": ["plan_id", "source"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len({tuple(r) for r in rows}) and not any(v is None for r in rows for v in r)
