"""Every analytics query against its SQL on the smallest tables."""

import duckdb
import pytest

from cadenza.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def cells(columns, rows):
    def one(x):
        if x is None or x != x:
            return None
        return round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(one(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got, want = cells(df.columns, df.collect()), cells(names, cur.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 3e-5) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0
