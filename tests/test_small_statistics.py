"""Closed-form helpers against published values and independent computation."""

import math

import numpy as np
import pytest

from tablescope.functions.normality import shapiro_wilk
from tablescope.functions.tails import (
    chi_square_tail,
    correlation_p_value,
    normal_two_sided,
    student_two_sided,
)


def test_student_known_quantiles():
    # tabulated two-sided 5 % points
    for df, t in ((1, 12.706205), (5, 2.570582), (10, 2.228139), (30, 2.042272), (120, 1.979930)):
        assert student_two_sided(t, df) == pytest.approx(0.05, abs=1e-7)


def test_student_two_degrees_closed_form():
    for t in (0.1, 1.0, 3.7, 25.0):
        assert student_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-12)


def test_student_is_one_curve_at_any_number_of_degrees():
    for t in (0.3, 2.0, 12.0, 20.0):
        below, above = student_two_sided(t, 99_999), student_two_sided(t, 100_001)
        # the slope by df is about t**4 / (4 df**2)
        assert below == pytest.approx(above, rel=max(1e-9, t**4 / 1e10))
    assert student_two_sided(1.959964, 1e12) == pytest.approx(0.05, abs=1e-7)
    for t in (0.0, 1e-9, 0.5, 3.0, 8.0):
        assert student_two_sided(t, 1e14) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-9)


def test_student_closed_forms():
    for t in (0.0, 1e-6, 0.2, 1.0, 4.0, 60.0):
        assert student_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-11)
        angle = t / math.sqrt(3)
        three = 1 - 2 / math.pi * (math.atan(angle) + angle / (1 + angle * angle))
        assert student_two_sided(t, 3) == pytest.approx(three, rel=1e-9)


def test_chi_square_even_degrees_finite_sum():
    for x in (0.3, 4.0, 11.0, 80.0, 400.0):
        assert chi_square_tail(x, 6) == pytest.approx(math.exp(-x / 2) * (1 + x / 2 + x * x / 8), rel=1e-10)
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert chi_square_tail(0.0, 4) == 1.0
    assert chi_square_tail(math.inf, 4) == 0.0


def test_correlation_p_value_edges():
    assert correlation_p_value(1.0, 10) == 0.0
    assert math.isnan(correlation_p_value(0.5, 2))
    assert math.isnan(correlation_p_value(float("nan"), 20))
    assert correlation_p_value(0.0, 20) == pytest.approx(1.0)
    assert correlation_p_value(0.6319, 10) == pytest.approx(0.05, abs=1e-4)  # tabulated critical r


def test_normal_tail():
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_shapiro_one_to_ten():
    w, p = shapiro_wilk(np.arange(1, 11))
    assert (w, p) == (pytest.approx(0.97016, abs=1e-4), pytest.approx(0.8924, abs=1e-3))


def test_shapiro_published_weights_example():
    # weights of men in pounds, Shapiro and Wilk (1965): W = 0.79
    w, p = shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005)
    assert p < 0.01


def test_shapiro_three_values():
    w, p = shapiro_wilk([1.0, 2.0, 3.0])
    assert (w, p) == (pytest.approx(1.0), pytest.approx(1.0))
    w, p = shapiro_wilk([0.0, 0.0, 1.0])
    assert (w, p) == (pytest.approx(0.75), pytest.approx(0.0, abs=1e-7))


def test_shapiro_tells_normal_from_skewed():
    rng = np.random.default_rng(3)
    assert shapiro_wilk(rng.standard_normal(400))[1] > 0.05
    assert shapiro_wilk(rng.exponential(size=400))[1] < 1e-6
    assert shapiro_wilk(np.full(20, 3.0)) == (1.0, 1.0)
    with pytest.raises(ValueError):
        shapiro_wilk([1.0, 2.0])


def test_shapiro_is_unchanged_by_shift_and_scale():
    x = np.random.default_rng(4).gamma(3.0, size=60)
    assert shapiro_wilk(x)[0] == pytest.approx(shapiro_wilk(1e6 + 250 * x)[0], rel=1e-8)
