"""Every query of the pipeline's own operators against its SQL, or for rows where SQL cannot say it."""

import pytest
from compare import connection, same

from loomwright.plans import problems, reference


@pytest.fixture(scope="module")
def con(folder):
    return connection(folder)


@pytest.mark.parametrize("name", sorted(reference.SQL))
def test_query_agrees_with_its_sql(spark, folder, con, name):
    assert same(reference.QUERIES[name](spark, folder), reference.SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted({*reference.QUERIES} - {*reference.SQL}))
def test_query_without_sql_gives_rows(spark, folder, name):
    assert reference.QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert "p2_found" in problems.queries()
