"""Every registered query of the library against its SQL in DuckDB, as sets of rows."""

import math

import pytest

from lattica.plans import registry

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "is_finite"):  # Decimal
        return round(float(v), 6)
    return v


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, wide_duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    rel = wide_duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(rel.fetchall(), names)
