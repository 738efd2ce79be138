"""Registered queries against DuckDB on the smallest tables (``tools/check.py`` does the same at any scale)."""
import os
import sys

import pytest
from conftest import FOLDER

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def db():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, db, name):
    assert check.compare(queries()[name](spark, FOLDER).toPandas(), db.execute(ORACLES[name]).df()) is None


def test_flagship(spark):
    assert entry(spark).count() > 0
