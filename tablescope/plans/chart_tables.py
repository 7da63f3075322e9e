"""The data behind each chart, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.columns import col
from tablescope.operators.correlation import ALPHA, CorrelationResult, lower_triangle
from tablescope.operators.factors import FactorResult
from tablescope.operators.pca import PCAResult

STRONG_LOADING = 0.4
ARROW_SHARE = 0.9
LABEL_FACTOR = 1.07
BIPLOT_POINTS = 2_000


def heatmap_cells(spark: SparkSession, result: CorrelationResult, mask: bool = True, alpha: float = ALPHA) -> DataFrame:
    """``(var_i, var_j, r, p_value, label)`` below the diagonal; the label is blank where not significant."""
    label = F.format_string("%.2f", F.col("r"))
    if mask:
        label = F.when(F.col("p_value") >= alpha, F.lit("")).otherwise(label)
    return lower_triangle(result.to_df(spark), result.columns).withColumn("label", label)


def variance_curve(spark: SparkSession, result: PCAResult) -> DataFrame:
    """``(component, cumulative_pct, threshold_pct, selected)``."""
    return result.variance_df(spark).select(
        "component",
        (F.col("cumulative") * 100).alias("cumulative_pct"),
        F.lit(result.variance_threshold * 100).alias("threshold_pct"),
        (F.col("component") == result.n_components).alias("selected"),
    )


def biplot_scale(result: PCAResult) -> float:
    """Arrow length unit: 0.9 of the largest absolute score over all kept components (one scan)."""
    sizes = [F.max(F.abs(F.col(c))) for c in result.components]
    largest = result.scores.agg(*[s.alias(f"m_{i}") for i, s in enumerate(sizes)]).first()
    return ARROW_SHARE * max(v for v in largest if v is not None)


def biplot_arrows(spark: SparkSession, result: PCAResult) -> DataFrame:
    """``(variable, x, y, label_x, label_y)`` of each variable in the plane of the first two components."""
    if result.n_components < 2:
        raise ValueError(f"a biplot needs at least 2 components, found {result.components}")
    scale = biplot_scale(result)
    loading = F.col("loading") * scale
    return (
        result.loadings_df(spark)
        .groupBy("variable")
        .agg(
            F.max(F.when(F.col("component") == "PC1", loading)).alias("x"),
            F.max(F.when(F.col("component") == "PC2", loading)).alias("y"),
        )
        .withColumns({"label_x": F.col("x") * LABEL_FACTOR, "label_y": F.col("y") * LABEL_FACTOR})
    )


def biplot_points(result: PCAResult, most: int | None = BIPLOT_POINTS) -> DataFrame:
    """Row points for display: at most ``most``, those whose keys have the smallest MD5; None gives all of them.

    The choice depends neither on partitions nor on the order of rows. Each task keeps ``most`` rows at a time. Tables without
    key columns are chosen from by their scores.
    """
    if most is None:
        return result.scores
    key = [c for c in result.scores.columns if c not in result.components] or list(result.components)
    text = F.concat_ws(",", *[col(c).cast("string") for c in key])
    return result.scores.orderBy(F.md5(text), *[col(c) for c in key]).limit(most)


def scree(spark: SparkSession, result: FactorResult) -> DataFrame:
    """``(rank, eigenvalue, above_one)``."""
    return result.eigenvalues_df(spark).withColumn("above_one", F.col("eigenvalue") > 1)


def loading_cells(spark: SparkSession, result: FactorResult) -> DataFrame:
    """``(variable, factor, loading, label, strong, title)``."""
    return result.loadings_df(spark).select(
        "variable",
        F.col("component").alias("factor"),
        "loading",
        F.round("loading", 2).cast("string").alias("label"),
        (F.abs("loading") >= STRONG_LOADING).alias("strong"),
        F.lit(f"Factor loadings, {result.rotation} rotation").alias("title"),
    )
