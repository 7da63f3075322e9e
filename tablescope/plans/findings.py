"""What a reader should notice in each result, as tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.columns import col
from tablescope.functions.tables import small_table
from tablescope.operators.factors import FactorResult
from tablescope.operators.famd import FAMDResult
from tablescope.operators.mca import MCAResult
from tablescope.operators.nearest import closest_pairs
from tablescope.operators.pca import PCAResult, top_variables

CONTRIBUTING_LOADING = 0.4
POOR_COMMUNALITY = 0.3


def kmo_grade(kmo: Column) -> Column:
    return (
        F.when(kmo.isNull() | F.isnan(kmo), "not computable")
        .when(kmo >= 0.8, "excellent")
        .when(kmo >= 0.7, "good")
        .when(kmo >= 0.6, "acceptable")
        .otherwise("insufficient")
    )


def communality_quality(communality: Column) -> Column:
    return F.when(communality >= 0.5, "good").when(communality >= 0.3, "medium").otherwise("weak")


def factor_adequacy(spark: SparkSession, result: FactorResult) -> DataFrame:
    """``(topic, value, verdict)`` for KMO, Bartlett's test and the rotation."""
    kmo, p = result.kmo_score, result.bartlett_p_value
    rotation = "factors assumed independent" if result.rotation == "varimax" else "factors may be correlated"
    rows = [
        ("kmo", f"{kmo:.3f}", "good adequacy" if kmo >= 0.7 else "acceptable adequacy" if kmo >= 0.6 else "weak adequacy"),
        ("bartlett", f"{p:.4f}", "significant correlations" if p < 0.05 else "no significant correlations"),
        ("rotation", result.rotation, rotation),
    ]
    return small_table(spark, rows, "topic string, value string, verdict string")


def factor_members(loadings: DataFrame, cut: float = CONTRIBUTING_LOADING) -> DataFrame:
    """``(component, variables)``: names above the cut in absolute loading, strongest first."""
    strong = loadings.where(F.abs("loading") > cut)
    entry = F.struct((-F.abs("loading")).alias("weight"), F.col("position"), F.col("variable"))
    ordered = F.array_sort(F.collect_list(entry))
    return strong.groupBy("component").agg(F.transform(ordered, lambda e: e["variable"]).alias("variables"))


def communalities(spark: SparkSession, result: FactorResult) -> DataFrame:
    """``(variable, communality, quality, poorly_represented)``."""
    value = F.col("communality")
    return result.communalities_df(spark).withColumns(
        {"quality": communality_quality(value), "poorly_represented": value < POOR_COMMUNALITY}
    )


def component_summary(spark: SparkSession, result: PCAResult, n_top: int = 5) -> DataFrame:
    """``(component, explained, variables)``: share as text and strongest variables of each kept component."""
    shares = small_table(
        spark,
        [(c, f"{s * 100:.1f}%") for c, s in zip(result.components, result.explained_variance_ratio)],
        "component string, explained string",
    )
    entry = F.struct("rank", "label")
    names = (
        top_variables(result.loadings_df(spark), n_top)
        .groupBy("component")
        .agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["label"]).alias("variables"))
    )
    return shares.join(names, "component", "left")


def level_extremes(coordinates: DataFrame) -> DataFrame:
    """``(dim, lowest, lowest_coordinate, highest, highest_coordinate)`` over ``(variable, level, dim, coordinate)``."""
    name = F.concat_ws("=", "variable", "level")
    low = F.min(F.struct("coordinate", name.alias("name")))
    high = F.min(F.struct((-F.col("coordinate")).alias("opposite"), name.alias("name")))
    return (
        coordinates.groupBy("dim")
        .agg(low.alias("low"), high.alias("high"))
        .select(
            "dim",
            F.col("low.name").alias("lowest"),
            F.col("low.coordinate").alias("lowest_coordinate"),
            F.col("high.name").alias("highest"),
            (-F.col("high.opposite")).alias("highest_coordinate"),
        )
    )


def closest_levels(spark: SparkSession, result: MCAResult, n_pairs: int = 10) -> DataFrame:
    """``(level_a, level_b, distance)``: the nearest level pairs on the kept axes, without comparing all of them.

    Few levels are sorted along the first axis and compared at growing steps, until even the first axis alone sets every
    pair farther apart than those found. Levels in a table meet in the cells of a grid (``closest_pairs``). Coordinates
    count to 12 decimals, so that levels with the same rows beside them are at one place; ties go by name.
    """
    if result.wide is None:
        names = [f"{result.levels.variables[v]}={text}" for v, text in result.levels.names]
        by_name = sorted(range(len(names)), key=names.__getitem__)
        found = _sweep(np.round(result.level_coordinates[by_name], 12), n_pairs)
        rows = [(names[by_name[i]], names[by_name[j]], d) for d, i, j in found]
        return small_table(spark, rows, "level_a string, level_b string, distance double")
    axis = F.struct("dim", (F.round("coordinate", 12) + F.lit(0.0)).alias("coordinate"))
    points = (
        result.levels_df(spark)
        .groupBy(F.concat_ws("=", "variable", "level").alias("name"))
        .agg(F.array_sort(F.collect_list(axis)).alias("cells"))
        .select("name", F.transform("cells", lambda c: c["coordinate"]).alias("at"))
    )
    found = closest_pairs(points, result.n_components, n_pairs)
    return found.withColumnsRenamed({"name_a": "level_a", "name_b": "level_b"})


def _sweep(points: np.ndarray, n_pairs: int) -> list[tuple[float, int, int]]:
    """The closest pairs ``(distance, i, j)`` with i < j, exactly; the first of equally close ones by i and j."""
    if not len(points):
        return []
    order = np.argsort(points[:, 0], kind="stable")
    sorted_points = points[order]
    best: list[tuple[float, int, int]] = []
    for step in range(1, len(points)):
        gaps = sorted_points[step:] - sorted_points[:-step]
        if len(best) == n_pairs and gaps[:, 0].min() > best[-1][0]:
            break
        far = np.sqrt((gaps**2).sum(axis=1))
        first, second = np.minimum(order[step:], order[:-step]), np.maximum(order[step:], order[:-step])
        for at in np.lexsort((second, first, far))[:n_pairs]:
            best.append((float(far[at]), int(first[at]), int(second[at])))
        best = sorted(best)[:n_pairs]
    return best


def strongest_on_axes(coordinates: DataFrame, n_top: int = 3) -> DataFrame:
    """``(dim, kind, rank, name, coordinate)``: largest absolute coordinates per axis, by kind of column."""
    name = F.concat_ws("=", "variable", "level")
    order = Window.partitionBy("dim", "kind").orderBy(F.abs("coordinate").desc(), name)
    return (
        coordinates.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n_top)
        .select("dim", "kind", "rank", name.alias("name"), "coordinate")
    )


def mixed_findings(spark: SparkSession, result: FAMDResult, n_top: int = 3) -> DataFrame:
    return strongest_on_axes(result.columns_df(spark), n_top)


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    """The table with its fractional columns rounded for display."""
    fractional = (T.FloatType, T.DoubleType)
    return df.select(
        *[
            (F.round(col(f.name), digits) if isinstance(f.dataType, fractional) else col(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )
