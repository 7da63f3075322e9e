import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope import TableAnalysis, column_profile, detect, routing_df
from tablescope.operators.describe import corrected_kurtosis, corrected_skewness, describe
from tablescope.operators.profile import Detection, kind_of, routing


def test_rules_in_order():
    def kind(d, n=1000):
        return kind_of(d, n, 0.05, 10)

    assert [kind(d) for d in (0, 1, 2, 3, 49, 50, 51)] == [
        "ignored", "ignored", "binary", "categorical", "categorical", "continuous", "continuous",
    ]
    # the near-constant rule can only fire on short tables
    assert [kind(d, 100) for d in (4, 5, 9, 10)] == ["categorical", "ignored", "ignored", "continuous"]


def test_detect_on_a_raw_table(spark):
    df = spark.range(200).select(
        F.col("id").alias("unique"), (F.col("id") % 5).alias("five"), (F.col("id") % 2).alias("two"),
        F.lit(1).alias("one"), (F.col("id") > 9).alias("flag"), F.col("id").cast("string").alias("text"),
        F.lit(None).cast("double").alias("nothing"),
        F.when(F.col("id") > 0, F.lit(3.0)).alias("three_and_gap"),
    )
    found = detect(df)
    assert found.kinds == {
        "unique": "continuous", "five": "categorical", "two": "binary", "one": "ignored", "flag": "binary",
        "text": "ignored", "nothing": "ignored", "three_and_gap": "ignored",
    }
    assert found.continuous == ["unique"]
    assert found.categorical == ["five", "two", "flag"]
    assert found.is_mixed
    lines = found.summary().splitlines()
    assert len(lines) == 4 and lines[0] == "continuous variables (1): unique"
    counts = {r["kind"]: r["n_variables"] for r in found.summary_df(spark).collect()}
    assert counts == {"continuous": 1, "categorical": 1, "binary": 2, "ignored": 4}


def test_kinds_next_to_their_limits(spark):
    df = spark.range(30_000).select(
        "id", (F.col("id") % 1400).alias("near"), (F.col("id") % 1600).alias("above"), (F.col("id") % 3).alias("three"),
        (F.col("id") % 2).alias("two"), (F.col("id") % 12_000).alias("many"),
    )
    assert detect(df).kinds == {
        "id": "continuous", "near": "categorical", "above": "continuous", "three": "categorical", "two": "binary",
        "many": "continuous",
    }


def test_parameters_are_checked(spark):
    for bad in ({"categorical_threshold": 0.0}, {"categorical_threshold": 1.0}, {"min_unique": 1}):
        with pytest.raises(ValueError):
            detect(spark.range(3), **bad)


def test_empty_detection_text():
    assert Detection({}).summary().splitlines()[0] == "continuous variables (0): —"


def test_profile(spark):
    df = spark.sql("SELECT * FROM VALUES (1.5D, 'a', true), (1.5D, 'b', null), (null, 'c', false) AS t(x, s, b)")
    rows = {r["variable"]: r for r in column_profile(df).collect()}
    assert set(rows) == {"x", "b"}
    assert (rows["x"]["n_rows"], rows["x"]["n_missing"], rows["x"]["n_distinct"], rows["x"]["mode"]) == (3, 1, 1, 1.5)


def test_routing():
    def applicable(**kinds):
        return {m: ok for m, ok, _ in routing(Detection(kinds))}

    assert applicable(a="continuous", b="continuous") == {
        "pca": True, "factor_analysis": True, "mca": False, "famd": False
    }
    assert applicable(a="continuous") == {"pca": False, "factor_analysis": False, "mca": False, "famd": False}
    assert applicable(a="binary", b="categorical")["mca"]
    assert applicable(a="binary", b="continuous") == {
        "pca": False, "factor_analysis": False, "mca": False, "famd": True
    }
    assert not any(applicable(a="ignored").values())


def test_routing_table(spark):
    assert routing_df(spark, Detection({"a": "continuous"})).columns == ["method", "applicable", "reason"]


def test_describe_equals_pandas(frame, messy):
    numbers = messy.select_dtypes("number")
    ours = describe(frame(messy)).toPandas().set_index("variable").loc[list(numbers)]
    filled = numbers.fillna(0.0)
    expected = filled.describe().T
    for mine, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                         ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        np.testing.assert_allclose(ours[mine].astype(float), expected[theirs], rtol=1e-10, atol=1e-12)
    np.testing.assert_allclose(ours["skewness"], filled.skew(), rtol=1e-8, atol=1e-10)
    np.testing.assert_allclose(ours["kurtosis"], filled.kurtosis(), rtol=1e-8, atol=1e-8)
    np.testing.assert_allclose(ours["missing_pct"], (numbers.isna().mean() * 100).round(2))


def test_moments_of_short_or_flat_columns():
    assert corrected_skewness(0.3, 2) is None
    assert corrected_kurtosis(0.3, 3) is None
    assert corrected_skewness(None, 5, constant=True) == 0.0
    assert corrected_kurtosis(None, 5, constant=True) == 0.0


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_describe_of_few_rows(spark, n):
    df = spark.range(n).select((F.col("id") * 2.0).alias("x"))
    row = describe(df).first()
    expected = pd.DataFrame({"x": [0.0, 2.0, 4.0][:n]}).describe()["x"]
    assert row["count"] == n
    for mine, theirs in (("mean", "mean"), ("std", "std"), ("q25", "25%")):
        got = row[mine]
        assert (got is None and np.isnan(expected[theirs])) or got == pytest.approx(expected[theirs])


def test_describe_rejects_text_and_unknown_columns(frame, messy):
    with pytest.raises(ValueError):
        describe(frame(messy), ["name"])
    with pytest.raises(ValueError):
        describe(frame(messy), ["absent"])


def test_analysis_needs_two_columns_and_rows(spark, frame):
    with pytest.raises(ValueError):
        TableAnalysis(frame(pd.DataFrame({"x": [1, 2, 3]})))
    with pytest.raises(ValueError):
        TableAnalysis(spark.createDataFrame([], "a double, b double")).pca()


def test_standardized(frame, messy):
    names = ["smooth", "spiky", "fixed"]
    got = TableAnalysis(frame(messy), names).standardized().toPandas()
    np.testing.assert_allclose(got.mean(), 0, atol=1e-12)
    np.testing.assert_allclose(got.std(ddof=0), [1, 1, 0], atol=1e-12)
