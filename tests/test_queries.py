"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from conftest import SF

from tessera.plans import registry


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, name):
    found = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    db = duckdb.connect()
    for path in Path(SF).iterdir():
        db.execute(f"create view {path.stem} as select * from '{path}'")
    result = db.execute(sql)
    columns = [x[0] for x in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows_of(rows, found.columns) == rows_of(result.fetchall(), columns)
