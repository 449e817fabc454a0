"""Every registered query against its DuckDB oracle (exact values) on the smallest scale."""

import pytest

import __spark_entry__ as E
from oracle_check import compare

from conftest import SF_SMALL

from tickframe.plans import registry

registry.load_all()
NAMES = sorted(registry.QUERIES)


def test_every_query_has_an_oracle_or_is_declared():
    assert set(NAMES) <= set(E.queries())
    missing = set(NAMES) - set(E.oracle_sql())
    assert missing == set(), missing


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "t_stamp" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    assert compare(spark, SF_SMALL, [name], verbose=False) == []
