"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lexmill import plans
from tests.conftest import SF

QUERIES, SQL = plans.queries(), plans.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return round(v, 7)
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as con:
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
        yield con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    if name not in SQL:
        assert got
        return
    rel = duck.execute(SQL[name])
    at = [[d[0] for d in rel.description].index(c) for c in columns]
    assert len(rel.description) == len(columns)
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
