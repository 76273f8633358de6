"""Every registered query against its DuckDB oracle on the smallest scale (sf0.001).

The driver runs the same comparison at sf0.01 (``python tests/oracle_check.py``).
"""

import pytest

from conftest import SF_SMALL
from oracle_check import compare, duck

import __spark_entry__ as E

_Q = E.queries()
_O = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(_O))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, _Q[name], _O[name], SF_SMALL)
    assert r["status"] == "ok", r


def test_every_oracle_has_a_query():
    assert set(_O) <= set(_Q)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["query_id", "rnk", "line"] or df.columns
