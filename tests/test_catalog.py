"""Every query of the catalogue against its SQL in another engine."""

import pytest

from tests.conftest import SF
from windrose import catalog


def bag(table, names):
    def norm(v):
        return v.replace(tzinfo=None) if hasattr(v, "tzinfo") and v is not None and v.tzinfo else v

    rows = list(zip(*[table.column(i).to_pylist() for i in range(table.num_columns)]))
    order = sorted(range(len(names)), key=lambda i: (names[i], i))
    return sorted([repr([norm(r[i]) for i in order]) for r in rows])


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toArrow()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
        return
    want = duck.sql(sql).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert sorted(got.column_names) == sorted(want.column_names)
    assert bag(got, got.column_names) == bag(want, want.column_names)
