"""Every query outside the llm subpackage against its SQL, over the smallest tables."""

import datetime as dt
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from bocage.plans import catalogue

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).iterdir():
        source = path / "*.parquet" if path.is_dir() else path
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_parity(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(repr(plain(r[c])) for c in columns) for r in df.collect())
    if name not in ORACLE:
        return
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert Counter(tuple(repr(plain(row[i])) for i in at) for row in result.fetchall()) == got
