"""Exact order statistics and ranks by counting scans, also on hostile distributions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.functions.columns import filled, measure
from tablescope.operators.quantiles import exact_quantiles, order_statistics
from tablescope.operators import quantiles as quantile_module
from tablescope.operators import ranks as rank_module
from tablescope.operators.ranks import average_ranks
from tablescope.operators import values as value_module
from tablescope.operators.values import distinct_by_bitmaps, distinct_counts, fits_bitmaps, value_summary

PROBABILITIES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def hostile(n=6000):
    rng = np.random.default_rng(11)
    return pd.DataFrame(
        {
            "normal": rng.standard_normal(n),
            "hot": np.where(rng.random(n) < 0.4, 7.25, rng.standard_normal(n) * 50),
            "decades": np.exp(rng.uniform(-600, 600, n)),
            "both_signs": rng.choice([-1, 1], n) * np.exp(rng.uniform(-300, 300, n)),
            "far": np.where(np.arange(n) == 3, 1e300, rng.random(n)),
            "widest": np.where(np.arange(n) % 2 == 0, -1.7e308, 1.7e308) * rng.random(n),
            "close": 1e9 + rng.integers(0, 5, n) * 1e-6,
            "whole": rng.integers(0, 9, n).astype(float),
            "constant": np.full(n, 3.5),
            "zeros": np.where(rng.random(n) < 0.5, -0.0, 0.0),
        }
    )


@pytest.mark.parametrize("fetch_rows", [10, 500, 100_000])
def test_quantiles_equal_sorting(frame, fetch_rows):
    pdf = hostile()
    df = frame(pdf)
    known = {c: (len(pdf), float(pdf[c].min()), float(pdf[c].max())) for c in pdf}
    found = exact_quantiles(df, PROBABILITIES, known, fetch_rows)
    for c in pdf:
        ordered = np.sort(pdf[c].to_numpy())
        for p, q in zip(PROBABILITIES, found[c]):
            h = (len(ordered) - 1) * p
            a, b = ordered[int(np.floor(h))], ordered[int(np.ceil(h))]
            assert q == a + (b - a) * (h - np.floor(h)), (c, p)


@pytest.mark.parametrize("fetch_rows", [10, 5_000])
def test_ranks_missed_by_their_sketches_are_found(frame, monkeypatch, fetch_rows):
    """Brackets far from their ranks: every rank lies in a gap."""
    pdf = hostile(3000)[["normal", "hot", "decades", "whole"]]
    df = frame(pdf)
    known = {c: (len(pdf), float(pdf[c].min()), float(pdf[c].max())) for c in pdf}
    far = {c: [(float(np.quantile(pdf[c], 0.9)), float(np.quantile(pdf[c], 0.95)))] for c in pdf}
    monkeypatch.setattr(quantile_module, "_sketched_brackets", lambda *a: far)
    found = order_statistics(df, {c: [0, 700, 1500, 2999] for c in pdf}, known, fetch_rows)
    for c in pdf:
        ordered = np.sort(pdf[c].to_numpy())
        assert found[c] == {k: ordered[k] for k in (0, 700, 1500, 2999)}


@pytest.mark.parametrize("fetch_rows", [100, 100_000])
def test_quantiles_read_the_table_twice(spark, tmp_path, fetch_rows):
    n = 300_000
    spark.range(0, n, 1, 4).selectExpr("id * 7919 % 300007 / 8 AS a", "CAST(id % 13 AS double) AS b").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    pdf = df.toPandas()
    known = {c: (n, float(pdf[c].min()), float(pdf[c].max())) for c in pdf}
    group = f"quantiles {fetch_rows}"
    spark.sparkContext.setJobGroup(group, group)
    found = exact_quantiles(df, (0.25, 0.5, 0.75), known, fetch_rows)
    for c in pdf:
        assert found[c] == list(np.quantile(pdf[c], (0.25, 0.5, 0.75)))
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    store = spark._jsparkSession.sparkContext().statusStore()
    read = sum(store.lastStageAttempt(s).inputRecords() for s in stages if tracker.getStageInfo(s))
    assert 2 * n <= read < 2.2 * n  # the rest are the values inside the brackets
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_quantiles_skip_missing_cells(frame):
    pdf = pd.DataFrame({"x": [4.0, np.nan, 1.0, np.inf, 3.0, -np.inf, 2.0]})
    df = frame(pdf)
    df = df.select(measure(df, "x").alias("x"))
    assert exact_quantiles(df, [0.5], {"x": (4, 1.0, 4.0)}, fetch_rows=1) == {"x": [2.5]}


def test_order_statistics_with_no_rows(frame):
    df = frame(pd.DataFrame({"x": [1.0]}))
    assert exact_quantiles(df.where("x > 5"), [0.5], {"x": (0, None, None)}) == {"x": [None]}
    assert order_statistics(df, {"x": [0]}, {"x": (1, 1.0, 1.0)}) == {"x": {0: 1.0}}


# all values looked up, some, none; values are then joined, the frequent ones dealt out
@pytest.mark.parametrize("looked_up, hot_rows", [(1_000_000, None), (4_000, 100), (0, 50), (0, None)])
def test_ranks_equal_pandas(frame, monkeypatch, looked_up, hot_rows):
    monkeypatch.setattr(rank_module, "BLOCK_CELLS", 4_000)  # equal values meet from several blocks
    pdf = hostile(3000)
    pdf["id"] = np.arange(len(pdf))
    df = frame(pdf, 5)
    names = [c for c in pdf if c != "id"]
    n, ranks = average_ranks(df, {c: filled(df, c) for c in names}, ["id"], looked_up, hot_rows)
    assert n == len(pdf)
    ours = ranks.toPandas().sort_values("id").reset_index(drop=True)[names]
    pd.testing.assert_frame_equal(ours, pdf[names].rank())


@pytest.mark.parametrize("looked_up", [1_000_000, 0])
def test_ranks_with_missing_cells(frame, looked_up):
    """NULL has no rank and counts for none; NaN is above every number; a column of NULLs stays one."""
    pdf = pd.DataFrame({"id": range(6), "x": [2.0, None, 2.0, 1.0, None, 5.0], "y": [None] * 6}).astype("float64")
    df = frame(pdf).selectExpr("id", "nanvl(x, null) AS x", "nanvl(y, null) AS y", "IF(id > 3, double('NaN'), id) AS z")
    n, ranks = average_ranks(df, {c: F.col(c) for c in "xyz"}, ["id"], looked_up)
    assert n == 6
    found = [tuple(r) for r in ranks.orderBy("id").select("x", "y", "z").collect()]
    assert found == [
        (2.5, None, 1.0), (None, None, 2.0), (2.5, None, 3.0), (1.0, None, 4.0), (None, None, 5.5), (4.0, None, 5.5),
    ]


@pytest.mark.parametrize("looked_up", [1_000_000, 0])
def test_identical_rows_are_spread_and_still_ranked(spark, looked_up):
    """A third of all rows are one and the same row, in every column."""
    df = spark.range(9000).select(
        *[F.when(F.col("id") % 3 == 0, F.lit(5.5)).otherwise(F.rand(i)).alias(f"x{i}") for i in range(2)]
    )
    df = df.select(*[F.round(c, 6).alias(c) for c in df.columns]).checkpoint()
    n, ranks = average_ranks(df, {c: F.col(c) for c in df.columns}, looked_up_values=looked_up, hot_rows=200)
    expected = df.toPandas().rank()
    ours = ranks.toPandas()
    for c in df.columns:
        assert sorted(ours[c]) == sorted(expected[c])
    assert ours.corr().iloc[0, 1] == pytest.approx(expected.corr().iloc[0, 1], rel=1e-12)


def test_ranks_of_nothing(frame):
    df = frame(pd.DataFrame({"x": [1.0]})).where("x > 3")
    for looked_up in (0, 10):
        n, ranks = average_ranks(df, {"x": F.col("x")}, looked_up_values=looked_up)
        assert (n, ranks.count()) == (0, 0)


def test_looked_up_ranks_move_no_row(frame):
    pdf = hostile(3000)[["normal", "whole"]]
    df = frame(pdf).checkpoint()
    _, ranks = average_ranks(df, {c: F.col(c) for c in pdf})
    assert "Exchange" not in ranks._jdf.queryExecution().executedPlan().toString()
    _, ranks = average_ranks(df, {c: F.col(c) for c in pdf}, looked_up_values=100)
    plan = ranks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # nine values are looked up


@pytest.mark.parametrize("looked_up", [1_000_000, 0])
def test_a_repeated_task_may_see_its_rows_in_another_order(spark, frame, looked_up):
    """Each run of the input's tasks deals its rows in a new order, as a task behind a shuffle does after a loss."""
    pdf = pd.DataFrame({"id": range(4000), "x": np.arange(4000) % 977 / 7.0, "y": (np.arange(4000) * 31 % 1009) * 1.5})

    def shuffled(batches):
        for batch in batches:
            yield batch.sample(frac=1.0)

    df = frame(pdf).mapInPandas(shuffled, "id long, x double, y double")
    first, again = ([r["id"] for r in df.collect()] for _ in range(2))
    assert first != again
    _, ranks = average_ranks(df, {c: F.col(c) for c in "xy"}, ["id"], looked_up, hot_rows=3)
    for _ in range(2):
        ours = ranks.toPandas().sort_values("id").reset_index(drop=True)
        pd.testing.assert_frame_equal(ours[["x", "y"]], pdf[["x", "y"]].rank())


def test_only_counted_values_are_shuffled(spark):
    """200,000 rows of nine values and of 500: the shuffle behind the ranges carries counts, not cells."""
    df = spark.range(0, 200_000, 1, 4).selectExpr("CAST(id % 9 AS double) AS few", "CAST(id % 500 AS double) AS more")
    spark.sparkContext.setJobGroup("ranks", "ranks")
    n, _ = average_ranks(df, {c: F.col(c) for c in df.columns}, looked_up_values=0)
    assert n == 200_000
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("ranks") for s in tracker.getJobInfo(j).stageIds}
    store = spark._jsparkSession.sparkContext().statusStore()
    moved = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages if tracker.getStageInfo(s))
    assert 509 <= moved <= 3_000
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_value_summary_counts_exactly(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1L, 2.0D, true), (1L, 2.0D, false), (9007199254740993L, double('NaN'), true),
           (9007199254740992L, null, null), (null, double('inf'), true) AS t(big, real, flag)"""
    )
    found = value_summary(df, ["big", "real", "flag"])
    assert (found["big"].n_distinct, found["big"].n_missing, found["big"].mode) == (3, 1, 1)
    assert (found["real"].n_distinct, found["real"].n_missing, found["real"].mode) == (1, 3, 2.0)
    assert (found["flag"].n_distinct, found["flag"].n_missing, found["flag"].mode) == (2, 1, 1)


def test_mode_takes_the_smallest_of_ties(frame):
    df = frame(pd.DataFrame({"x": [3.0, 3.0, -1.0, -1.0, 8.0], "k": [5, 4, 4, 5, 9]}))
    found = value_summary(df, ["x", "k"])
    assert (found["x"].mode, found["k"].mode) == (-1.0, 4)


def test_eight_columns_of_which_some_are_joined(frame):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({f"c{i}": np.round(rng.standard_normal(900) * 50, i % 3) for i in range(8)})
    pdf["c3"] = np.where(pdf.index % 3 == 0, 1.5, pdf["c3"])  # a third of the rows share one value
    df = frame(pdf.assign(row=range(900)))
    _, ranks = average_ranks(df, {c: F.col(c) for c in pdf}, key=["row"], looked_up_values=1_500, hot_rows=50)
    found = ranks.toPandas().sort_values("row")[list(pdf)].to_numpy()
    np.testing.assert_allclose(found, pdf.rank().to_numpy())


def plans_of(monkeypatch, run):
    """What ``run`` returns, and the executed plans of its frames."""
    seen = []
    summary, bitmaps = value_module.value_summary, value_module.distinct_by_bitmaps
    monkeypatch.setattr(value_module, "value_summary", lambda df, names, **k: seen.append(("values", list(names))) or summary(df, names, **k))
    monkeypatch.setattr(value_module, "distinct_by_bitmaps", lambda df, b: seen.append(("maps", list(b))) or bitmaps(df, b))
    return run(), seen


def test_whole_numbers_are_counted_by_bitmaps(spark, monkeypatch):
    big = 2**62
    df = spark.range(200_000).selectExpr(
        "id AS dense", f"{big} + id DIV 3 AS high", "-(id % 7) AS few", "id * 10000000 AS sparse", "id / 4 AS real",
        "CAST(NULL AS int) AS none", "IF(id % 3 = 0, -32768 * (id % 2), NULL) AS gaps", "CAST(id % 100 AS tinyint) AS tiny",
    )
    found, seen = plans_of(monkeypatch, lambda: distinct_counts(df.repartition(3), df.columns))
    assert found == {
        "dense": 200_000, "high": 66_667, "few": 7, "sparse": 200_000, "real": 200_000, "none": 0, "gaps": 2, "tiny": 100,
    }
    assert seen == [("maps", ["dense", "high", "few", "gaps", "tiny"]), ("values", ["sparse", "real"])]


def test_bitmaps_at_their_edges(spark):
    limit = value_module.BITMAP_BITS * value_module.BITMAPS
    assert fits_bitmaps((5, 5 + limit - 1)) and not fits_bitmaps((5, 5 + limit))
    rows = [(-(2**63), 32_767), (-(2**63) + limit - 1, 32_768), (-(2**63), 65_535), (None, 0), (-(2**63) + 32_767, -1), (-(2**63) + 32_768, -1)]
    df = spark.createDataFrame(rows, "low long, step long")
    assert distinct_by_bitmaps(df, {"low": (-(2**63), -(2**63) + limit - 1), "step": (-1, 65_535)}) == {"low": 4, "step": 5}
    assert distinct_counts(df.limit(0), ["low", "step"]) == {"low": 0, "step": 0}


def test_only_maps_are_shuffled(spark):
    df = spark.range(300_000).selectExpr("id AS dense", "id % 9 AS few")
    df.sparkSession.sparkContext.setJobGroup("maps", "maps")
    assert distinct_counts(df, ["dense", "few"]) == {"dense": 300_000, "few": 9}
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("maps") for s in tracker.getJobInfo(j).stageIds]
    store = spark._jsparkSession.sparkContext().statusStore()
    written = sum(store.lastStageAttempt(s.stageId).shuffleWriteRecords() for s in stages if s)
    assert written <= 200  # ten maps a task, not 300,000 values
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
