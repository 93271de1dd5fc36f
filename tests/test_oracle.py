import os

import oracle
import pytest

from panelloom.plans.catalog import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.database()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    oracle.compare(spark, con, QUERIES[name], ORACLE_SQL[name])
