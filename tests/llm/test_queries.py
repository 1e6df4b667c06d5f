"""Registered queries of the subpackage against their SQL, where they have it, on the smallest tables."""

import pytest

from seqforge.llm.queries import QUERIES, SQL
from tests.conftest import SF_SMALL
from tests.oracle import _rows, duck, type_mismatches


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    cur = duck(SF_SMALL).execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert not type_mismatches(df, cur)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, cur.fetchall())
