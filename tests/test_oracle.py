"""Every registered query against SQL on the smallest tables."""

import datetime as dt
import glob
import math
import os

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as driver
from panelcast.plans import checks, oracle

QUERIES = checks.registered()
ORACLE = oracle.statements()
ROWS = {
    "ingest_audit": None,
}
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "date": "DATE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def test_every_query_is_accounted_for():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == set(ROWS)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql())


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        return value.date() if isinstance(value, dt.datetime) else value

    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda row: [(v is None, str(v)) for v in row],
    )


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    expected = result.fetchall()
    assert {c: TYPES[t] for c, t in frame.dtypes} == types
    assert canonical(frame.collect(), frame.columns) == canonical(expected, columns)


@pytest.mark.parametrize("name", sorted(ROWS))
def test_rows(spark, name):
    frame = QUERIES[name](spark, SMALL)
    rows = frame.collect()
    assert rows and (ROWS[name] is None or len(rows) == ROWS[name])
    for column, kind in frame.dtypes:
        if kind == "double":
            assert all(r[column] is None or math.isfinite(r[column]) for r in rows)
