"""Every query that has SQL gives the rows that DuckDB gives for it, and every query runs."""

import math
from pathlib import Path

import duckdb
import pytest

from quern.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def shown(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return float(value) if hasattr(value, "as_tuple") else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(shown(row[k]) for k in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, rows) == rows_of(names, result.fetchall())
    else:
        assert rows
