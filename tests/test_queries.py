"""Registered queries against their oracle SQL at the smallest scale."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workloads.registry import TABLES

FOLDER = "/root/testdata/sf0.001"

# closed forms that assume more than 5,000 rows, or a p-value formula for many rows
LARGE_ONLY = {"normality_gate", "method_choice", "heatmap_labels"}


def shaped(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(v):
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - LARGE_ONLY))
def test_query_equals_oracle(spark, db, name):
    df = queries()[name](spark, FOLDER)
    found = db.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert shaped(df.columns, [tuple(r) for r in df.collect()]) == shaped(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_oracle_has_rows(spark, name):
    df = queries()[name](spark, FOLDER)
    assert df.count() > 0


def test_description_of_orders_that_repeat(spark, tmp_path):
    """Customers and prices have too few values for the analyses here; all three columns are described nevertheless."""
    copies = f"SELECT o.* REPLACE (o_orderkey + 1500 * i AS o_orderkey) FROM '{FOLDER}/orders.parquet' o, range(120) t(i)"
    duckdb.execute(f"COPY ({copies}) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    df = queries()["audit_description"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    found = db.execute(oracle_sql()["audit_description"])
    names = [d[0] for d in found.description]
    assert shaped(df.columns, [tuple(r) for r in df.collect()]) == shaped(names, found.fetchall())


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 8
