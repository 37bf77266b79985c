import pytest
from oracle import assert_same

from leafmill.plans import testdata

SQL = testdata.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    assert_same(testdata.queries()[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(testdata.queries()) - set(SQL)))
def test_query_runs(spark, sf, name):
    df = testdata.queries()[name](spark, sf)
    assert df.schema == testdata.queries()[name](spark, sf).schema
    assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
