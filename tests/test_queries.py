"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from noticeflow.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return int(value) if value == int(value) else round(value, 6)
    if isinstance(value, pd.Timestamp):
        return str(value.tz_localize(None) if value.tzinfo else value)
    return value


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        assert rows(got) == rows(duck.execute(registry.ORACLE_SQL[name]).df())
    else:
        assert len(got.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
