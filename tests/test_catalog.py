"""Every registered query against its SQL on the smallest tables, and the contract's shape."""

import os

import pytest

from quillon import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't there")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    if name in catalog.ORACLES:
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert got == sorted(map(repr, duck.execute(f"select {quoted} from ({catalog.ORACLES[name]})").fetchall()))
        assert sorted(c[0] for c in duck.execute(catalog.ORACLES[name]).description) == columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
