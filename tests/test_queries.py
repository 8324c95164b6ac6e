"""Every mail query gives the rows of its SQL."""

import pytest

from lettermill.plans import catalogue

from .oracle import connection, spark_rows, sql_rows


@pytest.fixture(scope="module")
def duck(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, small, duck, name):
    assert spark_rows(catalogue.QUERIES[name](spark, small)) == sql_rows(duck, catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "account_id", "uid", "from", "date", "size", "preview", "account_email", "mailbox_name"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
