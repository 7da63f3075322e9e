"""What Python workers need to run this package's functions."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager, redirect_stdout
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def import_path(spark: SparkSession) -> None:
    """Let Python workers of this machine import the package wherever the session was started."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *known]))


@contextmanager
def number_batches(df: DataFrame, rows: int) -> Iterator[None]:
    """What runs inside hands ``df``, a few numbers a row, to Python in batches of ``rows`` rows.

    Spark would compare the bytes of a batch with their limit at each row, which takes longer than handing the row over; rows
    of numbers are bounded by their count. The settings hold for a whole plan, so a table that comes from Python itself, maybe
    with long texts, keeps its batches.
    """
    spark, told = df.sparkSession, io.StringIO()
    with redirect_stdout(told):
        df.explain()
    own = re.search("Python|Pandas|Arrow", told.getvalue())
    limits = {} if own else {"maxRecordsPerBatch": rows, "maxBytesPerBatch": 2**31 - 1}
    before = {f"spark.sql.execution.arrow.{name}": spark.conf.get(f"spark.sql.execution.arrow.{name}") for name in limits}
    try:
        for name, limit in limits.items():
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(limit))
        yield
    finally:
        for name, limit in before.items():
            spark.conf.set(name, limit)
