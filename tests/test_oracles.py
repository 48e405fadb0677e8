"""Every query that SQL can express gives DuckDB's rows; every other runs. Whole small tables."""

import math

import duckdb
import pytest

from lodestrata import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value is False or value is True:
        return str(value)
    if isinstance(value, (int, float)):
        return "None" if isinstance(value, float) and math.isnan(value) else f"{float(value):.6g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, duck, sf_dir, name):
    got = plans.queries()[name](spark, sf_dir)
    cursor = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count() > 0
