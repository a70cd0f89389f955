"""Every registered query against its SQL in DuckDB on the given tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

CHECKS = entry.oracle_sql()
QUERIES = entry.queries()


DUCK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
    "double": "DOUBLE",
}


def canon(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return format(value, ".10g")
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    rows = result.collect()
    assert len(set(result.columns)) == len(result.columns)
    if name not in CHECKS:
        assert rows
        return
    expected = duck.execute(CHECKS[name])
    columns = [d[0] for d in expected.description]
    expected = expected.fetchall()
    assert sorted(columns) == sorted(result.columns)
    assert len(rows) == len(expected)
    assert expected, "a check on no rows checks nothing"
    got, want = table_of(result.columns, rows), table_of(columns, expected)
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, wrong[:3]
    types = {d[0]: str(d[1]) for d in duck.execute(CHECKS[name]).description}
    for field in result.schema:
        assert types[field.name] == DUCK_TYPES[field.dataType.simpleString()], field
