"""Every registered query against its SQL, row by row, on the same parquet files."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

QUERIES = entry_point.queries()
SQL = entry_point.oracle_sql()

# DuckDB type -> Spark type of an output column.
SAME_TYPE = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
}


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return repr(value)


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    assert got, "no rows"
    assert len(set(df.columns)) == len(df.columns)
    if name not in SQL:
        return
    answer = duck.execute(SQL[name])
    names = [c[0] for c in answer.description]
    types = {c[0]: str(c[1]) for c in answer.description}
    want = answer.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert {n: SAME_TYPE.get(t, t) for n, t in types.items()} == dict(df.dtypes)
    got, want = rows_of(got, df.columns), rows_of(want, names)
    assert len(got) == len(want)
    different = [(a, b) for a, b in zip(got, want) if a != b]
    assert not different, different[:3]
