"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import glob
import os

import pytest

import __spark_entry__ as entry_points
from formwright.plans import catalog, check_sql

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return connection


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        cells = []
        for i in order:
            x = row[i]
            cells.append(f"{x:.9g}" if isinstance(x, float) else str(x))
        out.append(tuple(cells))
    return sorted(out)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(check_sql.SQL)
    assert set(check_sql.SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = entry_points.queries()[name](spark, sf_dir)
    result = con.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    expected = normalized(columns, result.fetchall())
    assert expected
    assert normalized(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() == 1500
