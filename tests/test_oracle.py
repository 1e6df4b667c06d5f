"""Every registered query against its DuckDB twin on the smallest driver tables."""

import pytest

from seqforge.plans import catalog  # noqa: F401
from seqforge.plans.registry import REGISTRY
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck

NAMES = sorted(REGISTRY)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF_SMALL, con)
    assert r["status"] in ("ok", "rows-only"), r


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())
