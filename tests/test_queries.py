"""Every registered query over the graph gives what its SQL gives."""

import os

import duckdb
import pytest

from boundgraph.plans.catalogue import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "" if v is None else str(v)
    return sorted(names), sorted(tuple(text(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_sql(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    wanted = sql.execute(ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    assert rows(df.columns, df.collect()) == rows(names, wanted.fetchall())


def test_shell_keeps_few(spark):
    found = QUERIES["shell_cap"](spark, FOLDER).collect()
    for pack in {r["pack"] for r in found}:
        own = [r for r in found if r["pack"] == pack]
        assert sum(r["part"] != "edge" for r in own) == 8 and sum(r["part"] == "edge" for r in own) <= 12
        assert [r["hid"] for r in own if r["part"] == "seed"] == [pack]


def test_hop_list_of_a_customer_with_very_many_orders(spark, tmp_path):
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        one = "REPLACE (1 AS o_custkey)" if table == "orders" else ""
        con.execute(f"COPY (SELECT * {one} FROM '{FOLDER}/{table}.parquet') TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    df = QUERIES["hop_list"](spark, str(tmp_path))
    wanted = con.execute(ORACLE_SQL["hop_list"])
    assert df.where("seed = 'CUS_1'").count() > 1000
    assert rows(df.columns, df.collect()) == rows([d[0] for d in wanted.description], wanted.fetchall())
