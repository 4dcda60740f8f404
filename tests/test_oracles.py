"""Every registered query with an oracle gives the same rows in Spark and in DuckDB."""

import duckdb
import pytest

from lodestack import plans
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTRY = plans.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    def value(x):
        return round(x, 6) + 0.0 if isinstance(x, float) else x

    return sorted(repr(tuple(value(r[i]) for i in columns)) for r in rows)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_matches_oracle(spark, duck, name):
    q, sql = REGISTRY[name]
    df, want = q(spark, SF), duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = [tuple(r) for r in df.collect()]
    assert canonical(got, [df.columns.index(c) for c in order]) == canonical(want.fetchall(), [want.columns.index(c) for c in order])
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    for c, k in df.dtypes:
        assert kinds.get(k, types[c]) == types[c], c


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if not sql])
def test_runs_without_oracle(spark, name):
    assert REGISTRY[name][0](spark, SF).count() > 0
