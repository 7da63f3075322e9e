"""Registration of queries and their oracle SQL, and the tables they read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.workers import import_path
from tablescope.sources.catalog import register, run_query

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name; without SQL only its rows are checked."""
    def keep(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import_path(spark)
    return register(spark, name, f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, spread: str = "") -> DataFrame:
    """A table defined by SQL over the given tables; the same text serves the oracle.

    The rows of the table ``spread`` are dealt to several tasks a core first: a small file is read by one task, which would
    do alone whatever the SQL makes of its rows.
    """
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table = load(spark, sf_dir, name)
            if name == spread:
                table.repartition(4 * spark.sparkContext.defaultParallelism).createOrReplaceTempView(name)
    return run_query(spark, sql)


def num(name: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0.0 turns -0.0 into 0.0."""
    value = F.col(name) if isinstance(name, str) else name
    return F.round(value, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, **others: int) -> DataFrame:
    """All double columns rounded; ``others`` gives the digits of single columns."""
    return df.select(
        *[
            num(n, others.get(n, digits)).alias(n) if t == "double" else F.col(n)
            for n, t in df.dtypes
        ]
    )


def r(expression: str, name: str, digits: int = 6) -> str:
    """Oracle counterpart of ``num``."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS {name}"


# Tables derived from the given ones; the text is valid in both engines.

GAPPY_LINES = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS quantity,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS price,
       nullif(l_tax, 0) AS tax, nullif(l_discount, 0) AS discount
FROM lineitem
"""

PRICE_LINES = """
SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_extendedprice AS price,
       l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge
FROM lineitem
"""

# sums are rounded to the decimals they have: equal sums stay equal whatever the order of addition
ORDER_PROFILE = """
SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS total_quantity,
       round(sum(l_extendedprice), 2) AS total_price, round(sum(l_discount), 2) AS total_discount,
       round(sum(l_tax), 2) AS total_tax
FROM lineitem GROUP BY l_orderkey
"""

BAND_LINES = """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_extendedprice < 30000 THEN 'low' WHEN l_extendedprice < 65000 THEN 'middle' ELSE 'high' END
         AS price_band,
       CASE WHEN l_extendedprice * (1 - l_discount) < 45000 THEN 'small' ELSE 'large' END AS net_band,
       CASE WHEN l_quantity < 25 THEN 'few' ELSE 'many' END AS quantity_band,
       l_returnflag, l_linestatus, l_extendedprice * (1 + l_tax) AS gross, l_quantity AS quantity
FROM lineitem
"""
