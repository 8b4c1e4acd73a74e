"""Every query with an oracle against DuckDB at sf0.001."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = {k: f for k, f in entry.catalog.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(str([tidy(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name in entry.catalog.ORACLES:
        want = duck.execute(entry.catalog.ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert _rows(rows, got.columns) == _rows(want.fetchall(), columns)
    else:
        assert rows
