"""Every query against its SQL, in DuckDB, on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from specgraph import catalogue


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(cell(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, data, name):
    df = catalogue.queries()[name](spark, data)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    got = duck.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(got.fetchall(), names)
