import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from duck import connect, of_spark, of_sql

from weftline.plans import catalogue, oracles, pieces, queries

QUERIES, ORACLE_SQL = queries.QUERIES | catalogue.QUERIES | pieces.QUERIES, oracles.ORACLE_SQL | catalogue.ORACLE_SQL | pieces.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    got = of_spark(QUERIES[name](spark, sf_dir))
    if name in ORACLE_SQL:
        assert got == of_sql(connect(sf_dir), ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
