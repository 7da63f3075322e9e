"""Registered tables, SQL queries over them, shape and preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.columns import col, data_type
from pyspark.sql import types as T

DEFAULT_ROWS = 1000
PREVIEW_ROWS = 50
PREVIEW_MISSING = "—"


def register(spark: SparkSession, name: str, location: str, format: str = "parquet") -> DataFrame:
    """Make a file or folder available to SQL queries under ``name``."""
    df = spark.read.format(format).load(location)
    df.createOrReplaceTempView(name)
    return df


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def run_query(spark: SparkSession, query: str) -> DataFrame:
    """The result of a SQL query over the registered tables, as the table to analyse."""
    return spark.sql(query)


def default_query(tables: list[str]) -> str:
    """The first rows of the first table."""
    if not tables:
        raise ValueError("no table is registered")
    return f"SELECT * FROM {tables[0]} LIMIT {DEFAULT_ROWS}"


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """First rows as text, missing cells shown as a dash."""
    def shown(name: str):
        text = col(name).cast("string")
        if isinstance(data_type(df, name), (T.FloatType, T.DoubleType)):
            text = F.when(~F.isnan(col(name)), text)
        return F.coalesce(text, F.lit(PREVIEW_MISSING)).alias(name)

    return df.limit(n).select(*[shown(c) for c in df.columns])


def write_table(df: DataFrame, location: str, format: str = "parquet") -> None:
    """Write the table, replacing what was there."""
    df.write.mode("overwrite").format(format).save(location)
