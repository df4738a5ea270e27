"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from quarry.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = [tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in result.fetchall()]
    assert ordered(rows) == ordered(want)
