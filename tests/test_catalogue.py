"""Every query with SQL gives the SQL's rows; every other one gives rows."""

import os

import duckdb
import pytest

from lodestone.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(str(x) for x in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, sql, name):
    assert os.path.isdir(small)
    got = QUERIES[name](spark, small).toPandas()
    if name in ORACLE:
        assert rows(got) == rows(sql.execute(ORACLE[name]).fetchdf())
    else:
        assert len(got)
