"""Every query of the base package against its SQL twin, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from navspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x) + 0.0:.8g}"
    if isinstance(x, datetime.datetime):
        return str(x.date())
    return str(x)


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in found)


def test_names_differ_from_sql_only_where_sql_cannot():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"pca_evr", "schedule_weights", "backtest_scheduled", "frontier_exploration", "frontier_refined", "frontier_targets", "point_weights_budget"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, folder, duck, name):
    df = registry.queries()[name](spark, folder)
    got = rows(df.collect(), df.columns)
    cur = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(cur.fetchall(), columns)


def test_entry(spark, folder):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 5
    assert os.path.basename(__spark_entry__.SMOKE_DIR) == "sf0.001"
