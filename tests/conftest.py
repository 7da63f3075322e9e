import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tablescope-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """A pandas table as a DataFrame, NaN cells included."""
    def make(pdf: pd.DataFrame, partitions: int = 3):
        return spark.createDataFrame(pdf).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def two_factor():
    """168 rows whose correlations are known: u1, u2 load on one factor, v1, v2 on another, w on none.

    The columns combine seven orthogonal unit vectors, so corr(u1, u2) is exactly 0.96 * 0.9, corr(u1, v1) exactly 0.
    """
    waves = np.random.default_rng(2024).uniform(-1, 1, (168, 7))
    basis = np.linalg.qr(waves - waves.mean(axis=0))[0] * np.sqrt(168)
    f, g, *own = basis.T
    mix = lambda factor, load, rest: load * factor + np.sqrt(1 - load**2) * rest
    return pd.DataFrame(
        {
            "u1": mix(f, 0.96, own[0]), "u2": mix(f, 0.9, own[1]), "v1": mix(g, 0.94, own[2]), "v2": mix(g, 0.88, own[3]),
            "w": own[4],
        }
    )


@pytest.fixture(scope="session")
def messy():
    """120 readings: a smooth and a falling column, one with every seventh cell missing, one with four planted spikes,
    one that never changes, one of few values, and a text."""
    row = np.arange(120)
    spiky = np.cos(row * 1.7)
    spiky[[8, 31, 77, 101]] = [60.0, -75.0, 90.0, -44.0]
    return pd.DataFrame(
        {
            "smooth": np.sin(row / 5.0) + row / 60.0,
            "falling": 40.0 - np.sqrt(row + 1.0),
            "gappy": np.where(row % 7 == 3, np.nan, (row * 37 % 101) / 10.0),
            "spiky": spiky,
            "fixed": 7.0,
            "few": np.array([1.0, 2.0, 4.0])[(row % 40 == 0) * 1 + (row % 60 == 1) * 1],
            "label": "r",
        }
    )


@pytest.fixture(scope="session")
def personnel():
    """Mixed table: two related numbers, three categories, one of them related to the numbers."""
    rng = np.random.default_rng(5)
    n = 240
    base = rng.standard_normal(n)
    grade = np.select([base < -0.5, base < 0.6], ["junior", "middle"], "senior")
    return pd.DataFrame(
        {
            "id": np.arange(n),
            "pay": 30 + 5 * base + rng.standard_normal(n),
            "score": base + 0.5 * rng.standard_normal(n),
            "grade": grade,
            "site": rng.choice(["north", "south"], n),
            "team": np.where(rng.random(n) < 0.7, np.where(base > 0, "red", "blue"), "green"),
        }
    )
