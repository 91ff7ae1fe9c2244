import __spark_entry__ as E
from tests.conftest import SF


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["doc_id", "entity_id", "page_no", "title", "enterprise_ids", "enterprise_names", "body"]


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_all_queries_build_on_smallest_scale(spark):
    for name, fn in E.queries().items():
        df = fn(spark, SF)
        assert df.columns, name
