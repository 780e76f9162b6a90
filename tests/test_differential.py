"""Every registered query against DuckDB; nothing is skipped."""

import pytest
from compare import assert_same
from conftest import DATA

from quillon.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    assert_same(catalogue.queries()[name](spark, DATA), duck.sql(catalogue.oracle_sql()[name]))


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
