import pytest
from oracle import spark_rows, sql_rows

from tidemark import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_its_sql(spark, sf, name):
    assert spark_rows(plans.QUERIES[name](spark, sf)) == sql_rows(plans.ORACLE[name], sf)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_runs(spark, sf, name):
    df = plans.QUERIES[name](spark, sf)
    assert df.columns and df.limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(3).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
