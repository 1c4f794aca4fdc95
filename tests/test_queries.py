"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import numpy as np
import pytest

from tidemark.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(df):
    number = lambda v: isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_))
    of = df[sorted(df.columns)].astype(object)
    of = of.where(of.notna(), None).map(lambda v: str(round(float(v), 9)) if number(v) else str(v))
    return sorted(map(tuple, of.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, db, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
