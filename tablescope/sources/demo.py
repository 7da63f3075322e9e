"""A demonstration table of any size: two hidden factors behind eight readings of machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING_SHARE = 0.04

#: reading: (centre, spread, weight on the load, weight on the wear, decimals)
READINGS = {
    "throughput": (220.0, 40.0, 0.93, -0.10, 0),
    "power_kw": (75.0, 12.0, 0.90, 0.10, 1),
    "pressure_bar": (6.0, 0.8, 0.86, 0.00, 2),
    "vibration": (3.0, 0.9, 0.05, 0.91, 2),
    "noise_db": (71.0, 6.0, 0.15, 0.85, 1),
    "stops": (14.0, 4.0, 0.00, 0.84, 0),
    "scrap_pct": (4.0, 1.1, -0.05, 0.80, 2),
    "ambient_c": (19.0, 3.0, 0.00, 0.00, 1),
}
GAPPY = ("power_kw", "noise_db", "scrap_pct")

#: reading whose value is moved by so many spreads at one row: an outlier beyond doubt
PLANTED = {"throughput": 9.0, "stops": 11.0, "pressure_bar": -8.0}


def planted_rows(n_rows: int) -> dict[str, int]:
    """The rows of the outliers, at one, two and three quarters of the table."""
    return {name: n_rows * (i + 1) // 4 for i, name in enumerate(PLANTED)}


def demo_table(spark: SparkSession, n_rows: int = 240, seed: int = 7, partitions: int | None = None) -> DataFrame:
    """``row_id`` and eight columns; gaps in three of them, and three planted outliers.

    Values depend on seed and partitioning: fix ``partitions`` for the same table on every cluster.
    """
    hidden = spark.range(0, n_rows, 1, partitions).select(
        F.col("id").alias("row_id"), F.randn(seed).alias("load"), F.randn(seed + 1).alias("wear")
    )
    rows = planted_rows(n_rows)

    def reading(place: int, name: str) -> Column:
        centre, spread, load, wear, decimals = READINGS[name]
        rest = (1.0 - load**2 - wear**2) ** 0.5
        unit = F.col("load") * load + F.col("wear") * wear + F.randn(seed + 10 + place) * rest
        if name in PLANTED:
            unit = F.when(F.col("row_id") == rows[name], F.lit(PLANTED[name])).otherwise(unit)
        value = F.round(unit * spread + centre, decimals)
        if name in GAPPY:
            value = F.when(F.rand(seed + 30 + place) >= MISSING_SHARE, value)
        return value.alias(name)

    return hidden.select("row_id", *[reading(i, name) for i, name in enumerate(READINGS)])
