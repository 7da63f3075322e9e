"""Small driver-side results as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_table(spark: SparkSession, rows: Iterable[Sequence[Any]], schema: str) -> DataFrame:
    """A local relation: Arrow keeps it inside the plan, so reading it starts no Python worker."""
    fields = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows)) or [[] for _ in fields.names]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=fields)
