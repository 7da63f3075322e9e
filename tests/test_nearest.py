import numpy as np
import pytest

from tablescope.operators import nearest


def table(spark, at, partitions=3):
    rows = [(f"p{i:05d}", [float(x) for x in p]) for i, p in enumerate(at)]
    return spark.createDataFrame(rows, "name string, at array<double>").repartition(partitions)


def brute(at, n):
    at = np.asarray(at, dtype=float)
    i, j = np.triu_indices(len(at), 1)
    apart = np.sqrt(((at[i] - at[j]) ** 2).sum(axis=1))
    order = np.lexsort((j, i, apart))[:n]
    return [(f"p{i[k]:05d}", f"p{j[k]:05d}", apart[k]) for k in order]


def clustered(rng, n, axes):
    centres = rng.normal(0, 50, (12, axes))
    return centres[rng.integers(0, 12, n)] + rng.standard_cauchy((n, axes)) * 0.01


SHAPES = {
    "plane": lambda rng: rng.normal(0, 1, (400, 2)),
    "line": lambda rng: rng.uniform(-5, 5, (300, 1)),
    "clusters": lambda rng: clustered(rng, 400, 2),
    "five_axes": lambda rng: rng.uniform(0, 1, (250, 5)),
    "lattice": lambda rng: rng.integers(0, 12, (300, 2)) / 4.0,
    "third_at_one_place": lambda rng: np.where(np.arange(300)[:, None] % 3 == 0, 2.5, rng.normal(0, 1, (300, 2))),
    "one_place": lambda rng: np.full((40, 2), -3.25),
    "far_from_zero": lambda rng: 1e6 + rng.uniform(0, 1, (200, 2)),
    "four_points": lambda rng: rng.normal(0, 1, (4, 3)),
    "one_point": lambda rng: np.zeros((1, 2)),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_closest_pairs_equal_all_pairs(spark, shape):
    at = SHAPES[shape](np.random.default_rng(8))
    found = [tuple(r) for r in nearest.closest_pairs(table(spark, at), at.shape[1], 15).collect()]
    expected = brute(at, 15)
    assert [r[:2] for r in found] == [r[:2] for r in expected]
    np.testing.assert_allclose([r[2] for r in found], [r[2] for r in expected], rtol=1e-9, atol=1e-12)


def test_no_points(spark):
    empty = table(spark, np.zeros((1, 2))).limit(0)
    assert nearest.closest_pairs(empty, 2).collect() == []


@pytest.mark.parametrize("shape", ["plane", "clusters", "tail"])
def test_few_pairs_are_compared(spark, shape):
    """Far fewer than n * n / 2, also where the points are very unevenly spread."""
    rng, n = np.random.default_rng(3), 15_000
    at = {"plane": rng.normal(0, 1, (n, 2)), "clusters": clustered(rng, n, 2), "tail": rng.exponential(1, (n, 2)) ** 6}[shape]
    points = table(spark, at, 4).cache()
    apart = nearest.distance_bound(points, 2, 10)
    assert nearest.meeting_pairs(points, 2, apart).count() < 50 * n
    points.unpersist()
