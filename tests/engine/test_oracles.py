"""Every engine query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from kerbgraph.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(rows):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows if True) if not any(None in r for r in rows) else sorted((tuple((x is None, round(x, 9) if isinstance(x, float) else x) if x is not None else (True, 0) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*columns).collect()]
    theirs = duck.execute(f"select {', '.join(columns)} from ({plans.SQL[name]})").fetchall()
    assert shown(mine) == shown(theirs)
