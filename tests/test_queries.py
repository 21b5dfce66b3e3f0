"""Every query against the rows that its SQL twin gives in DuckDB."""

import math
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def results(spark):
    """Rows of all queries, several at a time: name -> (columns in order of names, rows) or what went wrong."""

    def run(name):
        try:
            df = QUERIES[name](spark, SF)
            names = sorted(df.columns)
            return names, df.select(*names).collect()
        except Exception as e:  # shown by the query's own test
            return e

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(QUERIES, pool.map(run, QUERIES), strict=True))


def rows_of(results, name):
    if isinstance(results[name], Exception):
        raise results[name]
    return results[name]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(results, db, name):
    names, rows = rows_of(results, name)
    found = db.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(results, name):
    assert rows_of(results, name)[1]
