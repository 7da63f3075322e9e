"""Extended descriptive statistics, one row per variable."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.tables import small_table
from tablescope.functions.columns import measure, pick_numeric
from tablescope.operators.quantiles import exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)

SCHEMA = (
    "variable string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, "
    "max double, skewness double, kurtosis double, missing_pct double"
)


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles, max, corrected skewness and excess kurtosis, % missing.

    Statistics see missing cells as 0, as the analyses do; ``missing_pct`` is measured before that.
    """
    names = pick_numeric(df, columns)
    slots = [f"c_{i}" for i in range(len(names))]
    frame = df.select(*[measure(df, c).alias(s) for c, s in zip(names, slots)])
    if not names:
        return small_table(df.sparkSession, [], SCHEMA)
    filled = frame.select(
        *[F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in slots], *[F.isnull(s).alias(f"{s}_gap") for s in slots]
    )
    # one row per cell and one group per column: the aggregate stays small enough for generated code
    cells = F.array(*[F.struct(F.col(s).alias("value"), F.col(f"{s}_gap").alias("gap")) for s in slots])
    found = (
        filled.select(F.posexplode(cells).alias("position", "cell"))
        .select("position", "cell.value", "cell.gap")
        .groupBy("position")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.skewness("value").alias("g1"),
            F.kurtosis("value").alias("g2"),
            F.count_if("gap").alias("gaps"),
        )
        .collect()
    )
    nothing = dict.fromkeys(("mean", "std", "min", "max", "g1", "g2")) | {"gaps": 0}
    row = {s: nothing for s in slots} | {slots[r["position"]]: r.asDict() for r in found}
    n = found[0]["n"] if found else 0
    quartiles = exact_quantiles(
        filled.select(*slots), QUARTILES, {s: (n, row[s]["min"], row[s]["max"]) for s in slots}
    )
    rows = []
    for c, s in zip(names, slots):
        r = row[s]
        constant = n > 0 and r["min"] == r["max"]
        rows.append(
            (
                c,
                n,
                r["mean"],
                0.0 if constant and n > 1 else r["std"],
                r["min"],
                *quartiles[s],
                r["max"],
                corrected_skewness(r["g1"], n, constant),
                corrected_kurtosis(r["g2"], n, constant),
                round(r["gaps"] / n * 100, 2) if n else None,
            )
        )
    return small_table(df.sparkSession, rows, SCHEMA)


def corrected_skewness(g1: float | None, n: int, constant: bool = False) -> float | None:
    """Bias-corrected skewness; undefined below 3 rows, 0 without spread."""
    if n < 3:
        return None
    if constant or g1 is None:
        return 0.0
    return math.sqrt(n * (n - 1)) / (n - 2) * g1


def corrected_kurtosis(g2: float | None, n: int, constant: bool = False) -> float | None:
    """Bias-corrected excess kurtosis; undefined below 4 rows, 0 without spread."""
    if n < 4:
        return None
    if constant or g2 is None:
        return 0.0
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
