import sys
from pathlib import Path

import pytest

from fieldspark.plans.catalogue import ORACLE_SQL, QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parent))
from oracle import SF, rows_of_query, rows_of_sql  # noqa: E402

pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert rows_of_query(spark, QUERIES[name]) == rows_of_sql(ORACLE_SQL[name])
