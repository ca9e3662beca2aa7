"""Every SQL-expressible query against DuckDB."""

import pytest
from helpers import SF, same

from weftline.plans import catalogue


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_matches_oracle(spark, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.SQL[name])


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.SQL])
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_point_has_a_query_for_each_oracle():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
