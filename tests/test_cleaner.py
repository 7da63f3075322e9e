from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler

from tablescope import sanitize
from tablescope.plans.cleaner import TableCleaner, TableCleanerModel


@pytest.fixture()
def readings(spark):
    """100 rows with an id of 64 bits, a gap in ten and one spike."""
    i = np.arange(100)
    level = np.where(i % 10 == 7, np.nan, np.sin(i))
    count = np.where(i == 50, 5000, i * 7 % 31)
    pdf = pd.DataFrame({"id": i, "large": 9007199254740993 + i, "level": level, "count": count, "flat": 1.0})
    return spark.createDataFrame(pdf)


def values(df):
    return sorted(map(tuple, df.collect()))


def test_model_equals_plan(readings):
    model = TableCleaner(zscoreThreshold=3.0, keyCols=["id"]).fit(readings)
    ours = model.transform(readings)
    assert ours.columns == ["id", "large", "level", "count"] and ours.count() == 99
    assert values(ours) == values(sanitize(readings, 3.0, key=["id"], fill_all=True).df)


def test_transform_moves_no_rows(readings):
    model = TableCleaner(keyCols=["id"]).fit(readings)
    plan = model.transform(readings)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("strategy", ["median", "mean", "most_frequent"])
def test_saved_model_is_the_same(spark, readings, tmp_path, strategy):
    model = TableCleaner(imputationStrategy=strategy, keyCols=["id"]).fit(readings)
    model.write().save(str(tmp_path / "model"))
    loaded = TableCleanerModel.load(str(tmp_path / "model"))
    assert loaded.plan == model.plan and loaded.uid == model.uid and loaded.getKeyCols() == ["id"]
    gaps = readings.selectExpr("id", "large", "nullif(level, level) AS level", "count", "flat")
    assert values(loaded.transform(gaps)) == values(model.transform(gaps))
    assert {r["level"] for r in loaded.transform(gaps).collect()} != {None}
    with pytest.raises(Exception, match="exists"):
        model.write().save(str(tmp_path / "model"))
    model.write().overwrite().save(str(tmp_path / "model"))


def test_saved_estimator_keeps_its_params(tmp_path):
    cleaner = TableCleaner(zscoreThreshold=2.5, minUniqueRatio=0.0, imputationStrategy="mean", keyCols=["a", "b"])
    cleaner.write().save(str(tmp_path / "cleaner"))
    loaded = TableCleaner.load(str(tmp_path / "cleaner"))
    named = {p.name: v for p, v in loaded.extractParamMap().items()}
    assert named == {p.name: v for p, v in cleaner.extractParamMap().items()}


def test_threshold_of_the_model_can_change(readings):
    model = TableCleaner(keyCols=["id"]).fit(readings)
    wide = model.copy({model.zscoreThreshold: 100.0})
    assert wide.transform(readings).count() == 100 and model.transform(readings).count() == 99
    assert replace(wide.plan) == model.plan


def test_stage_among_others(readings, tmp_path):
    stages = [TableCleaner(keyCols=["id"]), VectorAssembler(inputCols=["level", "count"], outputCol="features")]
    Pipeline(stages=stages).fit(readings).write().save(str(tmp_path / "pipeline"))
    found = PipelineModel.load(str(tmp_path / "pipeline")).transform(readings)
    assert found.count() == 99 and found.columns[-1] == "features"


def test_table_without_usable_columns(spark):
    model = TableCleaner().fit(spark.createDataFrame([("a",), ("b",)], "text string"))
    assert model.plan.columns == ()


def test_unknown_strategy(readings):
    with pytest.raises(ValueError, match="imputation_strategy"):
        TableCleaner(imputationStrategy="guess").fit(readings)
