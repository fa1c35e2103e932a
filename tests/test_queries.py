"""Every query of the library against its SQL."""

from __future__ import annotations

import math

import pytest

from veldoc.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def _plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows, columns = df.collect(), sorted(df.columns)
    if name in SQL:
        found = duck.sql(SQL[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert sorted(tuple(_plain(r[c]) for c in columns) for r in rows) == sorted(tuple(_plain(r[i]) for i in at) for r in found.fetchall())
