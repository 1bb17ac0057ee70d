"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from parlance import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted(repr(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns)) for r in result.fetchall())
