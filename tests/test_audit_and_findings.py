from dataclasses import replace
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope import TableAnalysis
from tablescope.operators.correlation import CorrelationResult
from tablescope.operators.mca import mca
from tablescope.operators.sanitize import sanitize
from tablescope.plans import chart_tables, findings
from tablescope.plans import audit as audit_module
from tablescope.plans.audit import AuditConfig, audit, kept_table
from tablescope.sources.demo import demo_table


@pytest.fixture(scope="module")
def analysis(frame, two_factor):
    return TableAnalysis(frame(two_factor))


def test_audit_of_the_demo_table(spark):
    table = demo_table(spark, 240, partitions=1).drop("row_id")
    found = audit(table)
    assert found.report.imputed_values == sum(int(n) for n in table.toPandas().isna().sum())
    assert found.report.outliers_removed >= 3
    steps = {r["step"]: r["status"] for r in found.steps_df(spark).collect()}
    assert steps == {
        "sanitize": "ok", "requirements": "ok", "detect": "ok", "correlation": "ok", "pca": "ok",
        "factor_analysis": "ok", "mca": "skipped", "famd": "skipped",
    }
    strong = np.abs(found.factors.loadings) > 0.6
    names = list(found.factors.variables)
    groups = [{names[i] for i in np.flatnonzero(strong[:, k])} for k in range(2)]
    assert {"throughput", "power_kw", "pressure_bar"} in groups
    assert {"vibration", "noise_db", "stops", "scrap_pct"} in groups
    assert found.description.count() == 8
    found.release()


def test_audit_is_reproducible(spark, frame, messy):
    first, second = audit(frame(messy)), audit(frame(messy))
    assert first.report == second.report and first.detection == second.detection
    np.testing.assert_allclose(first.pca.loadings, second.pca.loadings)


def test_audit_of_a_mixed_table(spark):
    df = spark.range(400).select(
        "id", (F.col("id") * 7 % 400 * 1.5).alias("x"), (F.col("id") % 4).alias("four"),
        (F.col("id") % 2).cast("double").alias("two"), (F.col("id") * 31 % 397 + F.col("id")).alias("y"),
    )
    config = AuditConfig(min_unique_ratio=0.0, reuse="table")
    found = audit(df, config, key=["id"])
    assert found.detection.continuous == ["x", "y"] and found.detection.categorical == ["four", "two"]
    assert [s for s in found.steps if s[1] != "ok"] == []
    for rows in (found.pca.scores, found.mca.row_coordinates, found.famd.row_coordinates):
        assert rows.columns[0] == "id" and rows.count() == 400


def test_audit_of_categories_only(spark):
    df = spark.range(300).select((F.col("id") % 4).alias("four"), (F.col("id") % 6).alias("six"))
    found = audit(df, AuditConfig(min_unique_ratio=0.0))
    steps = {s[0]: s[1] for s in found.steps}
    assert (steps["correlation"], steps["pca"], steps["mca"], steps["famd"]) == ("skipped", "skipped", "ok", "skipped")


def test_audit_stops_on_small_tables(spark):
    found = audit(spark.range(5).select("id", (F.col("id") * 2).alias("b")))
    assert found.steps[-1] == ("requirements", "failed", "rows: 5, at least 10 needed")
    assert found.detection is None and found.description is None
    with pytest.raises(ValueError):
        audit(spark.range(0))


def test_columns_of_few_values_are_described(spark):
    cells = [f"CAST(id % {n} AS DOUBLE) AS {c}" for c, n in (("thirds", 3), ("fifths", 5), ("fixed", 1))]
    found = audit(spark.range(3000).selectExpr("id", *cells), AuditConfig(reuse="table"))
    assert found.steps[-1] == ("requirements", "failed", "columns: 1, at least 2 needed")
    rows = {r["variable"]: r for r in found.description.collect()}
    assert {c: (r["count"], r["mean"], r["q50"], r["max"]) for c, r in rows.items()} == {
        "id": (3000, 1499.5, 1499.5, 2999.0), "thirds": (3000, 1.0, 1.0, 2.0), "fifths": (3000, 2.0, 2.0, 4.0),
        "fixed": (3000, 0.0, 0.0, 0.0),
    }
    found.release()


def test_description_without_the_outliers(spark):
    cells = "CAST(id % 1500 AS DOUBLE) + if(id = 7, 1e9, 0) AS x", "CAST(id % 3 AS DOUBLE) AS few"
    found = audit(spark.range(3000).selectExpr("id", *cells))
    assert {r["variable"]: r["count"] for r in found.description.collect()} == {"id": 2999, "x": 2999, "few": 2999}


def test_a_failing_section_does_not_stop_the_audit(spark, monkeypatch):
    def broken(*args, **options):
        raise RuntimeError("executor lost\nat line 1")

    monkeypatch.setattr(audit_module, "mca", broken)
    df = spark.range(400).select(
        "id", (F.col("id") * 17 % 397).alias("x"), (F.col("id") % 5).alias("five"), (F.col("id") % 7).alias("seven")
    )
    status = {s[0]: s for s in audit(df).steps}
    assert status["mca"][1:] == ("failed", "executor lost")
    assert status["pca"][1] == status["famd"][1] == "ok"


def test_categories_with_thousands_of_levels(spark):
    df = spark.range(120_000).select(
        "id", (F.col("id") * 17 % 119_993).alias("x"), (F.col("id") % 5500).alias("many"), (F.col("id") % 3).alias("three")
    )
    found = audit(df, AuditConfig(min_unique_ratio=0.0, reuse="table"))
    assert [s for s in found.steps if s[1] != "ok"] == []
    assert found.mca.n_levels == 5503 and found.famd.row_coordinates.count() == 120_000
    folder = found.clean.inputFiles()[0].rpartition("/")[0].removeprefix("file:")
    found.release()
    assert not Path("/" + folder.lstrip("/")).exists()


@pytest.mark.parametrize(
    "bad",
    [
        {"zscore_threshold": 1.9}, {"zscore_threshold": 5.1}, {"categorical_threshold": 0.21}, {"variance_threshold": 0.5},
        {"n_factors": 0}, {"n_factors": 11}, {"rotation": "none"}, {"imputation": "knn"}, {"reuse": "cache"},
    ],
)
def test_configuration_ranges(bad):
    with pytest.raises(ValueError):
        AuditConfig(**bad)


def test_configuration_defaults():
    config = AuditConfig()
    assert (config.zscore_threshold, config.imputation, config.categorical_threshold) == (3.0, "median", 0.05)
    assert (config.variance_threshold, config.n_factors, config.rotation) == (0.80, None, "varimax")


def test_heatmap(spark):
    matrix = np.array([[1, 0.456, -0.02], [0.456, 1, 0.3], [-0.02, 0.3, 1]])
    p = np.array([[1, 0.01, 0.7], [0.01, 1, 0.05], [0.7, 0.05, 1]])
    result = CorrelationResult(("A", "B", "C"), 50, matrix, p, "pearson", [], True)
    cells = {(r["var_i"], r["var_j"]): r["label"] for r in chart_tables.heatmap_cells(spark, result).collect()}
    assert cells == {("B", "A"): "0.46", ("C", "A"): "", ("C", "B"): ""}
    shown = {r["label"] for r in chart_tables.heatmap_cells(spark, result, mask=False).collect()}
    assert shown == {"0.46", "-0.02", "0.30"}


@pytest.mark.parametrize("how, jobs", [("table", 0), ("none", 1)])
def test_rows_are_counted_while_the_clean_table_is_written(spark, how, jobs):
    cleaned = kept_table(sanitize(demo_table(spark, 240, partitions=3).drop("row_id")), how)
    spark.sparkContext.setJobGroup(f"report {how}", "report")
    rows = cleaned.report.n_rows_output
    assert min(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"report {how}")), 1) == jobs
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows == cleaned.df.count() == 240 - cleaned.report.outliers_removed < 240


def test_variance_curve(spark, analysis):
    found = analysis.pca()
    curve = chart_tables.variance_curve(spark, found).orderBy("component").collect()
    assert [r["component"] for r in curve] == [1, 2, 3, 4, 5]
    assert curve[-1]["cumulative_pct"] == pytest.approx(100.0)
    assert [r["component"] for r in curve if r["selected"]] == [found.n_components]


def test_biplot(spark, analysis):
    found = analysis.pca()
    scale = 0.9 * np.abs(found.scores.toPandas().to_numpy()).max()
    arrows = chart_tables.biplot_arrows(spark, found).toPandas().set_index("variable").loc[list(found.variables)]
    np.testing.assert_allclose(arrows["x"], found.loadings[:, 0] * scale)
    np.testing.assert_allclose(arrows["label_y"], found.loadings[:, 1] * scale * 1.07)
    assert chart_tables.biplot_points(found).count() == chart_tables.biplot_points(found, None).count() == 168
    few = [tuple(r) for r in chart_tables.biplot_points(found, 50).collect()]
    spread = replace(found, scores=found.scores.repartition(7))
    assert len(few) == 50 and sorted(few) == sorted(tuple(r) for r in chart_tables.biplot_points(spread, 50).collect())


def test_scree_and_loading_cells(spark, analysis):
    found = analysis.factor_analysis(rotation="promax")
    bars = chart_tables.scree(spark, found).orderBy("rank").collect()
    assert [r["above_one"] for r in bars] == [v > 1 for v in found.eigenvalues]
    cells = chart_tables.loading_cells(spark, found).collect()
    assert all(c["strong"] == (abs(c["loading"]) >= 0.4) for c in cells)
    assert cells[0]["title"] == "Factor loadings, promax rotation"


def loadings_table(spark):
    rows = [
        (v, i, f, float(x))
        for i, (v, pair) in enumerate(
            {"var1": (0.85, -0.10), "var2": (0.76, 0.08), "var3": (0.12, 0.82), "var4": (-0.4, -0.79)}.items()
        )
        for f, x in zip(("F1", "F2"), pair)
    ]
    return spark.createDataFrame(rows, "variable string, position int, component string, loading double")


def test_factor_members_are_above_the_cut(spark):
    found = {r["component"]: r["variables"] for r in findings.factor_members(loadings_table(spark)).collect()}
    assert found == {"F1": ["var1", "var2"], "F2": ["var3", "var4"]}


def test_grades(spark):
    values = spark.createDataFrame([(x,) for x in (None, float("nan"), 0.8, 0.79, 0.6, 0.59)], "k double")
    assert [r[0] for r in values.select(findings.kmo_grade(F.col("k"))).collect()] == [
        "not computable", "not computable", "excellent", "good", "acceptable", "insufficient",
    ]
    shares = spark.createDataFrame([(0.5,), (0.49,), (0.3,), (0.29,)], "c double")
    assert [r[0] for r in shares.select(findings.communality_quality(F.col("c"))).collect()] == [
        "good", "medium", "medium", "weak",
    ]


def test_factor_findings(spark, analysis):
    found = analysis.factor_analysis()
    rows = {r["topic"]: r for r in findings.factor_adequacy(spark, found).collect()}
    assert rows["kmo"]["value"] == f"{found.kmo_score:.3f}"
    assert rows["bartlett"]["verdict"] == "significant correlations"
    assert rows["rotation"]["verdict"] == "factors assumed independent"
    table = findings.communalities(spark, found).collect()
    assert all(r["poorly_represented"] == (r["communality"] < 0.3) for r in table)


def test_component_findings(spark, analysis):
    found = analysis.pca()
    rows = findings.component_summary(spark, found, 2).orderBy("component").collect()
    assert rows[0]["explained"] == f"{found.explained_variance_ratio[0] * 100:.1f}%"
    assert len(rows[0]["variables"]) == 2


def test_level_findings(spark, frame, personnel):
    result = mca(frame(personnel), ["grade", "site", "team"])
    table = result.levels_df(spark)
    names = [f"{result.variables[q]}={t}" for q, t in result.levels.names]
    first = findings.level_extremes(table).where("dim = 'Dim1'").first()
    assert first["lowest"] == names[int(np.argmin(result.level_coordinates[:, 0]))]
    assert first["highest"] == names[int(np.argmax(result.level_coordinates[:, 0]))]
    pairs = findings.closest_levels(spark, result, 4).collect()
    every = sorted(
        float(np.linalg.norm(result.level_coordinates[i] - result.level_coordinates[j]))
        for i in range(len(names))
        for j in range(i)
    )
    np.testing.assert_allclose([r["distance"] for r in pairs], every[:4])
    wide = mca(frame(personnel), ["grade", "site", "team"], dense_levels=3)
    pairs = findings.closest_levels(spark, wide, 4).collect()
    np.testing.assert_allclose([r["distance"] for r in pairs], every[:4], atol=1e-6)


def test_sweep_equals_all_pairs():
    points = np.random.default_rng(4).integers(0, 9, (60, 2)) / 4.0
    every = sorted(float(np.linalg.norm(points[i] - points[j])) for i in range(60) for j in range(i))
    for n in (1, 7, 2000):
        np.testing.assert_allclose([d for d, *_ in findings._sweep(points, n)], every[:n])


def test_strongest_and_rounded(spark):
    rows = [("pay", None, "continuous", "Dim1", 0.91234), ("grade", "senior", "level", "Dim1", -1.5),
            ("grade", "junior", "level", "Dim1", 1.2), ("score", None, "continuous", "Dim1", -0.95)]
    table = spark.createDataFrame(rows, "variable string, level string, kind string, dim string, coordinate double")
    top = {r["kind"]: r["name"] for r in findings.strongest_on_axes(table, 1).collect()}
    assert top == {"continuous": "score", "level": "grade=senior"}
    assert findings.rounded(table).first()["coordinate"] == 0.912


def test_whole_analysis_in_one_go(spark, frame, two_factor):
    analysis = TableAnalysis(frame(two_factor), variance_threshold=0.75)
    found = analysis.pca()
    assert found.cumulative_variance[found.n_components - 1] >= 0.75
    assert analysis.factor_analysis(n_factors=2).loadings.shape == (5, 2)
    assert isinstance(found.loadings_df(spark).toPandas(), pd.DataFrame)
    described = set(analysis.describe().columns)
    assert {"skewness", "kurtosis", "missing_pct"} <= described
