import __spark_entry__
import pytest
from millrace import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    compare(spark, __spark_entry__, name, sf_dir)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
