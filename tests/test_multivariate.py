import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablescope import TableAnalysis
from tablescope.operators import levels as levels_module
from tablescope.functions.normality import shapiro_wilk
from tablescope.operators.correlation import normality, normality_df
from tablescope.operators.factors import bartlett_sphericity, kmo, minimum_residual, promax, varimax
from tablescope.operators.famd import famd
from tablescope.operators.levels import burt_matrix, count_levels
from tablescope.operators.mca import mca
from tablescope.operators.moments import cross_moments
from tablescope.operators.pca import first_reaching, positive_peaks, top_variables
from tablescope.functions.columns import filled


# ---- moments and correlation -------------------------------------------------------------------------------------

def test_moments_equal_numpy(frame, two_factor):
    df = frame(two_factor)
    found = cross_moments(df, {c: filled(df, c) for c in two_factor})
    np.testing.assert_allclose(found.mean, two_factor.mean(), atol=1e-12)
    np.testing.assert_allclose(found.cov, np.cov(two_factor.T, ddof=0), atol=1e-12)


def test_many_columns_in_one_scan(frame):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.standard_normal((90, 45)) + np.arange(45) * 1e4, columns=[f"c{i}" for i in range(45)])
    pdf["c7"] = 2.0
    df = frame(pdf)
    found = cross_moments(df, {c: filled(df, c) for c in pdf})
    np.testing.assert_allclose(found.cov, np.cov(pdf.T, ddof=0), atol=1e-9)
    np.testing.assert_allclose(found.mean, pdf.mean(), rtol=1e-14)
    assert found.n == 90 and np.flatnonzero(found.constant).tolist() == [7]
    nothing = cross_moments(df.limit(0), {"c0": filled(df, "c0")})
    assert nothing.n == 0


@pytest.mark.parametrize("columns", [3, 41])
def test_a_missing_cell_among_many_columns(frame, columns):
    pdf = pd.DataFrame({f"c{i}": np.arange(30) * (i + 1.5) % 11 for i in range(columns)})
    pdf.loc[4, "c1"] = np.nan
    with pytest.raises(ValueError, match=r"missing cells: \['c1'\]"):
        famd(frame(pdf.assign(kind=list("abc") * 10)), [f"c{i}" for i in range(columns)], ["kind"])


def test_large_offsets_do_not_lose_digits(frame, two_factor):
    pdf = two_factor[["u1", "u2"]] * 1e-3 + 1e6
    df = frame(pdf)
    found = cross_moments(df, {c: filled(df, c) for c in pdf})
    assert found.correlation()[0, 1] == pytest.approx(0.96 * 0.9, abs=1e-6)


def test_missing_cells_are_refused_by_moments(frame):
    df = frame(pd.DataFrame({"x": [1.0, np.nan, 2.0]})).select(F.nanvl("x", F.lit(None)).alias("x"))
    with pytest.raises(ValueError, match="missing"):
        cross_moments(df, {"x": F.col("x")})


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_equals_pandas(frame, messy, method):
    numbers = messy.select_dtypes("number").fillna(0.0)
    result = TableAnalysis(frame(messy)).correlation(method)
    np.testing.assert_allclose(result.matrix, numbers.corr(method).to_numpy(), atol=1e-12)
    np.testing.assert_allclose(result.matrix, result.matrix.T)
    assert np.all(np.diag(result.p_matrix) == 1.0)
    assert result.method == method


def test_normal_columns_choose_pearson(spark, frame, two_factor):
    result = TableAnalysis(frame(two_factor)).correlation()
    assert result.method == ("pearson" if result.all_normal else "spearman")
    assert {r.variable for r in result.normality} == set(two_factor)
    skewed = TableAnalysis(frame(two_factor.assign(f=np.exp(two_factor["u1"] * 2)))).correlation()
    assert skewed.method == "spearman" and not skewed.all_normal
    table = {r["variable"]: r for r in normality_df(spark, skewed.normality).collect()}
    assert not table["f"]["is_normal"] and 0 < table["f"]["w"] < 1
    assert round(table["u1"]["p_value"], 4) == table["u1"]["p_value"]


@pytest.mark.parametrize("n", [3, 5, 11, 12, 600])
def test_normality_of_columns_equals_that_of_samples(spark, frame, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"bell": rng.normal(1e5, 2, n), "ties": rng.integers(0, 4, n) * 1.0, "fixed": 7.1, "tail": rng.pareto(1, n)})
    pdf.loc[0, "ties"] = 9.0
    df = frame(pdf)
    for found in normality(df, {c: F.col(c) for c in pdf}, n):
        w, p = shapiro_wilk(pdf[found.variable].to_numpy())
        assert (found.w, found.p) == (pytest.approx(w, rel=1e-7), pytest.approx(p, rel=1e-4, abs=1e-9))
        assert found.is_normal == (p >= 0.05)


@pytest.mark.parametrize("n", [2, 5001])
def test_no_normality_test_outside_the_limits(spark, n):
    df = spark.range(n).select("id", (F.col("id") * F.col("id")).alias("square"))
    result = TableAnalysis(df).correlation()
    assert all(r.w is None and not r.is_normal for r in result.normality)
    assert result.method == "spearman"


def test_correlation_tables(spark, frame, two_factor):
    result = TableAnalysis(frame(two_factor)).correlation("pearson")
    assert result.to_df(spark).count() == 25
    assert result.wide_df(spark).columns == ["variable", *two_factor.columns]
    cells = result.significant_df(spark)
    assert cells.count() == 10
    shown = {(r["var_i"], r["var_j"]): r["r"] for r in cells.collect()}
    assert shown[("u2", "u1")] == pytest.approx(0.96 * 0.9)
    with pytest.raises(ValueError):
        TableAnalysis(frame(two_factor)).correlation("kendall")


# ---- principal components ----------------------------------------------------------------------------------------

def test_pca_equals_singular_values(frame, two_factor):
    analysis = TableAnalysis(frame(two_factor.assign(row=range(168))), key=["row"])
    found = analysis.pca()
    z = (two_factor - two_factor.mean()) / two_factor.std(ddof=0)
    u, s, vt = np.linalg.svd(z.to_numpy(), full_matrices=False)
    np.testing.assert_allclose(found.cumulative_variance, np.cumsum(s**2) / (s**2).sum())
    weights = positive_peaks(vt.T)[:, : found.n_components]
    np.testing.assert_allclose(found.loadings, weights, atol=1e-8)
    scores = found.scores.toPandas().sort_values("row")
    np.testing.assert_allclose(scores[found.components], z.to_numpy() @ weights, atol=1e-8)
    assert found.scores.columns == ["row", *found.components]
    assert found.loadings.shape == (5, found.n_components)


def test_component_rule():
    cumulative = np.array([0.5, 0.8, 0.95, 1.0])
    assert [first_reaching(cumulative, s) for s in (0.1, 0.8, 0.81, 1.0, 1.1)] == [1, 2, 3, 4, None]


@pytest.mark.parametrize("threshold", [0.1, 0.75, 0.95, 1.0])
def test_threshold_is_respected_with_two_at_least(frame, two_factor, threshold):
    found = TableAnalysis(frame(two_factor), variance_threshold=threshold).pca()
    assert 2 <= found.n_components <= 5
    assert found.cumulative_variance[found.n_components - 1] >= threshold - 1e-12
    assert found.variance_threshold_reached


def test_unreachable_threshold_keeps_all(frame, two_factor):
    found = TableAnalysis(frame(two_factor), variance_threshold=1.01).pca()
    assert found.n_components == 5 and not found.variance_threshold_reached


def test_equal_loadings_keep_table_order():
    flipped = positive_peaks(np.array([[-1.0, 1.0], [1.0, 1.0]]) / np.sqrt(2))
    np.testing.assert_allclose(flipped[:, 0] * np.sqrt(2), [1.0, -1.0])


def test_top_variables(spark, frame, two_factor):
    analysis = TableAnalysis(frame(two_factor))
    found = analysis.pca()
    table = analysis.top_variables(found, n_top=3)
    assert table.columns == ["rank", *found.components] and table.count() == 3
    assert analysis.top_variables(found, n_top=50).count() == 5
    best = top_variables(found.loadings_df(spark), 1).where("component = 'PC1'").first()
    strongest = int(np.argmax(np.abs(found.loadings[:, 0])))
    assert best["variable"] == two_factor.columns[strongest]
    assert best["label"] == f"{best['variable']} ({found.loadings[strongest, 0]:+.3f})"


def test_pca_scores_are_narrow(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    found = TableAnalysis(df, ["l_quantity", "l_tax"], key=["l_orderkey"]).pca()
    plan = found.scores._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "l_extendedprice" not in plan


# ---- factor analysis ---------------------------------------------------------------------------------------------

def planted(loadings, uniqueness=None):
    r = loadings @ loadings.T
    np.fill_diagonal(r, 1.0)
    return r


PLANTED = np.array([[0.8, 0.0], [0.7, 0.1], [0.6, 0.0], [0.1, 0.75], [0.0, 0.65], [0.05, 0.7]])


def test_extraction_recovers_a_planted_structure():
    r = planted(PLANTED)
    found = minimum_residual(r, 2)
    assert found.converged
    np.testing.assert_allclose(found.loadings @ found.loadings.T, PLANTED @ PLANTED.T, atol=1e-6)
    np.testing.assert_allclose(found.uniqueness, 1 - (PLANTED**2).sum(axis=1), atol=1e-6)


def test_extraction_is_a_minimum():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 7)) @ rng.standard_normal((7, 7))
    r = np.corrcoef(x.T)
    found = minimum_residual(r, 2)

    def loss(psi):
        theta = np.linalg.eigvalsh(r - np.diag(psi))[:-2]
        return float(theta @ theta)

    best = loss(found.uniqueness)
    for _ in range(200):
        other = np.clip(found.uniqueness + rng.normal(0, 0.02, 7), 0.005, 1.0)
        assert loss(other) >= best - 1e-9
    assert np.all((found.uniqueness >= 0.005) & (found.uniqueness <= 1.0))


def test_bounded_uniqueness():
    # r12 r13 / r23 > 1 would need a negative uniqueness
    r = np.array([[1, 0.9, 0.9], [0.9, 1, 0.7], [0.9, 0.7, 1]])
    found = minimum_residual(r, 1)
    assert found.converged
    assert found.uniqueness[0] == pytest.approx(0.005)


def test_varimax_keeps_communalities_and_simplifies():
    angle = 0.6
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    rotated = varimax(PLANTED @ turn)
    np.testing.assert_allclose((rotated**2).sum(axis=1), (PLANTED**2).sum(axis=1), atol=1e-12)
    np.testing.assert_allclose(np.sort(np.abs(rotated).max(axis=1)), np.sort(PLANTED.max(axis=1)), atol=0.05)
    one = PLANTED[:, :1]
    np.testing.assert_array_equal(varimax(one), one)


def test_varimax_criterion_cannot_be_improved():
    rotated = varimax(PLANTED @ np.array([[0.8, -0.6], [0.6, 0.8]]))

    def criterion(loadings):
        rows = loadings / np.sqrt((loadings**2).sum(axis=1))[:, None]
        return float(((rows**2) ** 2).mean(axis=0).sum() - ((rows**2).mean(axis=0) ** 2).sum())

    best = criterion(rotated)
    for angle in np.linspace(-0.7, 0.7, 41):
        turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        assert criterion(rotated @ turn) <= best + 1e-12


def test_promax_reproduces_the_common_part():
    pattern, between = promax(PLANTED)
    np.testing.assert_allclose(np.diag(between), 1.0)
    np.testing.assert_allclose(pattern @ between @ pattern.T, PLANTED @ PLANTED.T, atol=1e-10)


def test_kmo_three_variables_closed_form():
    r = np.array([[1, 0.5, 0.4], [0.5, 1, 0.3], [0.4, 0.3, 1]])
    partial = [
        (0.5 - 0.4 * 0.3) / np.sqrt((1 - 0.16) * (1 - 0.09)),
        (0.4 - 0.5 * 0.3) / np.sqrt((1 - 0.25) * (1 - 0.09)),
        (0.3 - 0.5 * 0.4) / np.sqrt((1 - 0.25) * (1 - 0.16)),
    ]
    plain = 0.25 + 0.16 + 0.09
    assert kmo(r) == pytest.approx(plain / (plain + sum(a * a for a in partial)))


def test_bartlett():
    r = np.array([[1, 0.5], [0.5, 1]])
    test = bartlett_sphericity(r, 100)
    assert test.statistic == pytest.approx(-np.log(0.75) * (99 - 9 / 6))
    assert test.df == 1 and 0 < test.p_value < 1e-6
    singular = bartlett_sphericity(np.ones((2, 2)), 100)
    assert singular.singular and singular.p_value == 0.0


@pytest.mark.parametrize("rotation", ["varimax", "promax", None])
def test_factor_analysis_finds_the_two_factors(frame, two_factor, rotation):
    found = TableAnalysis(frame(two_factor)).factor_analysis(n_factors=2, rotation=rotation)
    assert found.loadings.shape == (5, 2)
    assert np.all(found.communalities >= 0)
    assert 0 <= found.kmo_score <= 1
    if rotation:
        strong = np.abs(found.loadings) > 0.7
        assert strong[0].tolist() == strong[1].tolist() != strong[2].tolist() == strong[3].tolist()


def test_factor_options(frame, two_factor):
    analysis = TableAnalysis(frame(two_factor))
    automatic = analysis.factor_analysis()
    assert automatic.n_factors == int((automatic.eigenvalues > 1).sum()) and automatic.factor_rule == "kaiser"
    assert analysis.factor_analysis(n_factors=9).n_factors == 4
    for bad in ({"rotation": "quartimax"}, {"n_factors": 0}):
        with pytest.raises(ValueError):
            analysis.factor_analysis(**bad)


def test_flat_columns_leave_the_factor_analysis(frame, two_factor):
    found = TableAnalysis(frame(two_factor.assign(flat=1.25))).factor_analysis()
    assert found.dropped == ("flat",) and found.variables == tuple(two_factor.columns)
    with pytest.raises(ValueError):
        TableAnalysis(frame(pd.DataFrame({"a": [1.0, 2.0], "b": [3.0, 3.0]}))).factor_analysis()


def test_collinear_columns_do_not_fail(frame, two_factor):
    found = TableAnalysis(frame(two_factor.assign(twice=two_factor["u1"] * 2))).factor_analysis(n_factors=2)
    assert found.loadings.shape == (6, 2) and np.isfinite(found.loadings).all()


# ---- multiple correspondence analysis ----------------------------------------------------------------------------

def indicator(pdf, names):
    return pd.concat([pd.get_dummies(pdf[c], prefix=c) for c in names], axis=1).to_numpy(dtype=float)


def test_burt_equals_indicator_products(frame, personnel):
    names = ["grade", "site", "team"]
    df = frame(personnel)
    levels = count_levels(df, names)
    z = indicator(personnel, names)
    np.testing.assert_array_equal(burt_matrix(df, levels), z.T @ z)


def test_pairs_without_the_combination_step(frame, personnel, monkeypatch):
    names = ["grade", "site", "team"]
    df = frame(personnel)
    levels = count_levels(df, names)
    direct = burt_matrix(df, levels)
    monkeypatch.setattr(levels_module, "MAX_COMBINATIONS", 1)
    np.testing.assert_array_equal(burt_matrix(df, levels), direct)


def test_mca_equals_correspondence_analysis_of_the_indicators(frame, personnel):
    names = ["grade", "site", "team"]
    found = mca(frame(personnel), names, key=["id"])
    z = indicator(personnel, names)
    p = z / z.sum()
    rows, cols = p.sum(axis=1), p.sum(axis=0)
    u, s, vt = np.linalg.svd((p - np.outer(rows, cols)) / np.sqrt(np.outer(rows, cols)), full_matrices=False)
    np.testing.assert_allclose(found.eigenvalues, s[:2] ** 2)
    np.testing.assert_allclose(found.all_eigenvalues.sum(), found.total_inertia)
    assert found.total_inertia == pytest.approx(8 / 3 - 1)
    weights = positive_peaks(vt.T)[:, :2]
    signs = np.sign((weights * vt.T[:, :2]).sum(axis=0))
    np.testing.assert_allclose(found.level_coordinates, weights * s[:2] / np.sqrt(cols)[:, None], atol=1e-9)
    coordinates = found.row_coordinates.toPandas().sort_values("id")[["Dim1", "Dim2"]].to_numpy()
    np.testing.assert_allclose(coordinates, u[:, :2] * s[:2] * signs / np.sqrt(rows)[:, None], atol=1e-9)


def test_mca_tables_and_bases(spark, frame, personnel):
    names = ["grade", "site", "team"]
    kept = mca(frame(personnel), names, inertia_basis="kept")
    assert kept.total_inertia_explained == pytest.approx(1.0)
    assert kept.inertia_df(spark).collect()[-1]["cumulative_pct"] == 100.0
    total = mca(frame(personnel), names)
    assert total.total_inertia_explained < 1.0
    levels = total.levels_df(spark).toPandas()
    for dim, value in zip(("Dim1", "Dim2"), total.eigenvalues):
        part = levels[levels["dim"] == dim]
        assert (part["mass"] * part["coordinate"] ** 2).sum() == pytest.approx(value)
    with pytest.raises(ValueError):
        mca(frame(personnel), names, inertia_basis="other")


def test_mca_arguments(frame, personnel):
    df = frame(personnel)
    with pytest.raises(ValueError, match="none of"):
        mca(df, ["absent"])
    with pytest.raises(ValueError, match="at least 2"):
        mca(df, ["grade", "absent"])
    assert mca(df, ["grade", "site"], n_components=5).n_components == 1
    assert mca(df, ["grade", "site", "team", "absent"], n_components=5).n_components == 2


@pytest.mark.parametrize("dense_levels", [6, 4, 3, 2])
def test_wide_variables_give_the_same_mca(frame, personnel, dense_levels):
    """One, two, then all variables too wide for the dense matrix."""
    names, df = ["grade", "site", "team"], frame(personnel)
    whole, split = mca(df, names, key=["id"]), mca(df, names, key=["id"], dense_levels=dense_levels)
    assert split.wide is not None and split.n_levels == whole.n_levels == 8
    np.testing.assert_allclose(split.eigenvalues, whole.eigenvalues, rtol=1e-8)
    assert split.total_inertia == pytest.approx(whole.total_inertia)
    for table, order, shown in (
        ("levels", ["variable", "level", "dim"], ["coordinate", "mass"]), ("rows", ["id"], ["Dim1", "Dim2"]),
    ):
        a, b = (
            (r.row_coordinates if table == "rows" else r.levels_df(df.sparkSession)).toPandas().sort_values(order)
            for r in (whole, split)
        )
        np.testing.assert_allclose(b[shown], a[shown], atol=1e-6)
        assert list(a.columns) == list(b.columns)


@pytest.mark.parametrize("dense_levels", [6, 3, 1])
def test_wide_variables_give_the_same_famd(frame, personnel, dense_levels):
    numbers, names, df = ["pay", "score"], ["grade", "site", "team"], frame(personnel)
    whole = famd(df, numbers, names, n_components=3, key=["id"])
    split = famd(df, numbers, names, n_components=3, key=["id"], dense_levels=dense_levels)
    np.testing.assert_allclose(split.eigenvalues, whole.eigenvalues, rtol=1e-8)
    assert split.total_inertia == pytest.approx(whole.total_inertia)
    np.testing.assert_allclose(split.relationships, whole.relationships, atol=1e-6)
    np.testing.assert_allclose(split.continuous_coordinates, whole.continuous_coordinates, atol=1e-6)
    dims = ["Dim1", "Dim2", "Dim3"]
    a, b = (r.row_coordinates.toPandas().sort_values("id")[dims] for r in (whole, split))
    np.testing.assert_allclose(b, a, atol=1e-6)
    order = ["variable", "level", "dim"]
    a, b = (r.columns_df(df.sparkSession).toPandas().sort_values(order)["coordinate"] for r in (whole, split))
    np.testing.assert_allclose(b, a, atol=1e-6)


@pytest.mark.parametrize("full_cells", [0, 4])
def test_blocks_of_pairs_give_the_product(spark, monkeypatch, full_cells):
    """Full and sparse blocks, of two tasks and three columns, against indicators multiplied out; no shuffle of pairs."""
    from tablescope.operators import level_krylov

    monkeypatch.setattr(level_krylov, "FULL_CELLS", full_cells)
    rng = np.random.default_rng(4)
    cells = np.column_stack([rng.integers(0, k, 700) for k in (30, 11, 5)])
    pdf = pd.DataFrame(cells, columns=list("abc")).astype(str)
    starts = (0, 30, 41)
    levels = [{str(i): start + i for i in range(k)} for start, k in zip(starts, (30, 11, 5))]
    pairs = level_krylov.pair_blocks(spark.createDataFrame(pdf).repartition(2), levels)
    assert {len(r["row"]) > 0 for r in pairs.collect()} == {full_cells == 0}
    shown = np.zeros((700, 46))
    for start, column in zip(starts, cells.T):
        shown[np.arange(700), start + column] = 1
    met = shown.T @ shown
    for start, k in zip(starts, (30, 11, 5)):
        met[start : start + k, start : start + k] = 0
    t = rng.standard_normal((46, 3))
    np.testing.assert_allclose(level_krylov.block_product(pairs, t), met @ t, atol=1e-9)


def test_levels_too_many_to_be_sent_are_joined(frame, personnel, monkeypatch):
    from tablescope.operators import level_krylov

    names, df = ["grade", "site", "team"], frame(personnel)
    sent = mca(df, names, dense_levels=2)
    monkeypatch.setattr(level_krylov, "SENT_NUMBERS", 0)
    joined = mca(df, names, dense_levels=2)
    np.testing.assert_allclose(joined.eigenvalues, sent.eigenvalues, rtol=1e-8)
    a, b = (r.levels_df(df.sparkSession).toPandas().sort_values(["variable", "level", "dim"]) for r in (sent, joined))
    np.testing.assert_allclose(b["coordinate"], a["coordinate"], atol=1e-6)


def test_blocks_hold_counts_in_few_bytes_and_get_no_texts(spark):
    """300 rows of one pair do not fit a byte, single rows do; Python gets hashes of the texts."""
    from tablescope.operators import level_krylov

    levels = [{"x": 0, "y": 1}, {"u": 2, "v": 3}]
    for rows, size in ((300, 2), (3, 1)):
        table = spark.createDataFrame([("x", "u")] * rows + [("y", "v")], "a string, b string").coalesce(1)
        pairs = level_krylov.pair_blocks(table, levels)
        (block,) = pairs.collect()
        assert np.frombuffer(bytes(block["together"]), f"<u{size}").tolist() == [rows, 0, 0, 1]
        np.testing.assert_allclose(level_krylov.block_product(pairs, np.eye(4)), np.array(
            [[0, 0, rows, 0], [0, 0, 0, 1], [rows, 0, 0, 0], [0, 1, 0, 0]]))
    assert "string" not in pairs._jdf.queryExecution().analyzed().apply(1).schema().simpleString()
    with pytest.raises(Exception, match="changed between scans"):
        level_krylov.pair_blocks(table, [{"x": 0, "y": 1}, {"u": 2}]).collect()


def test_a_seed_is_found_without_collisions(spark, monkeypatch):
    """With the first two seeds all texts share a hash; rows and blocks must come out as ever."""
    from tablescope.functions.columns import text_hash
    from tablescope.operators import level_krylov, wide_levels

    df = spark.range(900).select("id", (F.col("id") * 7919 % 97).alias("a"), (F.col("id") % 89).alias("b"))
    names = ["a", "b"]
    usual = mca(df, names, key=["id"], dense_levels=20).row_coordinates.toPandas().sort_values("id")
    seeds = []

    def colliding(text, seed):
        seeds.append(seed)
        return text_hash(text, seed) if seed > 1 else F.lit(1).cast("bigint")

    for module in (level_krylov, wide_levels):
        monkeypatch.setattr(module, "text_hash", colliding)
    found = mca(df, names, key=["id"], dense_levels=20).row_coordinates.toPandas().sort_values("id")
    assert set(seeds) == {0, 1, 2}
    np.testing.assert_allclose(found["Dim1"].abs(), usual["Dim1"].abs(), atol=1e-5)


def test_rows_meet_many_levels_without_a_shuffle(spark):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        df = spark.range(900).select("id", (F.col("id") * 7919 % 97).alias("a"), (F.col("id") % 89).alias("b"))
        rows = mca(df, ["a", "b"], key=["id"], dense_levels=20).row_coordinates
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and "Exchange hashpartitioning" not in plan
        assert rows.count() == 900
    finally:
        spark.conf.set(setting, before)


def test_batches_of_numbers(spark):
    """More rows a batch for tables of numbers; what comes from Python keeps its batches, and settings come back."""
    from tablescope.functions.workers import number_batches

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(n) for n in names]
    plain = spark.range(0, 30_000, numPartitions=1)
    passed = plain.mapInArrow(lambda batches: batches, "id bigint")
    for df, most in ((plain, 30_000), (passed, 10_000)):
        with number_batches(df, 1 << 18):
            assert max(r["n"] for r in df.mapInArrow(sizes, "n bigint").collect()) == most
        assert [spark.conf.get(n) for n in names] == before


def test_a_small_file_is_dealt_to_several_tasks(spark):
    from workloads.correspondence import CROSSED
    from workloads.registry import derived

    one = derived(spark, "/root/testdata/sf0.001", CROSSED)
    many = derived(spark, "/root/testdata/sf0.001", CROSSED, spread="customer")
    assert many.rdd.getNumPartitions() > one.rdd.getNumPartitions()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))


def test_levels_that_grow_with_the_rows(spark):
    """A category of one level in three rows, with a level that holds a third of all rows."""
    df = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id").cast("long") / 6).cast("long").alias("many"),
        (F.col("id") % 4).alias("four"), (F.col("id") * 7 % 101 / 3.0).alias("x"),
    )
    found = famd(df, ["x"], ["many", "four"], key=["id"], dense_levels=100)
    rows = found.row_coordinates.agg(F.count("*").alias("n"), F.var_pop("Dim1").alias("a"), F.avg("Dim2").alias("b")).first()
    assert rows["n"] == 9000 and rows["a"] == pytest.approx(found.eigenvalues[0]) and abs(rows["b"]) < 1e-8
    assert found.total_inertia == pytest.approx(1 + found.wide.select("level").distinct().count() + 4 - 2)


def test_missing_cells_are_a_level(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1.0D), (null, 2.0D), ('b', double('NaN')), ('a', null) AS t(s, x)")
    levels = count_levels(df, ["s", "x"])
    assert levels.names == ((0, "a"), (0, "b"), (0, "nan"), (1, "1.0"), (1, "2.0"), (1, "nan"))
    assert levels.rows.tolist() == [2, 1, 1, 1, 1, 2]


# ---- mixed data --------------------------------------------------------------------------------------------------

def test_famd_equals_the_explicit_matrix(spark, frame, personnel):
    numbers, names = ["pay", "score"], ["grade", "site", "team"]
    found = famd(frame(personnel), numbers, names, n_components=3, key=["id"])
    z = ((personnel[numbers] - personnel[numbers].mean()) / personnel[numbers].std(ddof=0)).to_numpy()
    g = indicator(personnel, names)
    share = g.mean(axis=0)
    a = np.hstack([z, (g - share) / np.sqrt(share)])
    u, s, vt = np.linalg.svd(a / np.sqrt(len(a)), full_matrices=False)
    np.testing.assert_allclose(found.eigenvalues, s[:3] ** 2)
    assert found.total_inertia == pytest.approx(2 + 2 + 1 + 2)
    weights = positive_peaks(vt.T)[:, :3]
    rows = found.row_coordinates.toPandas().sort_values("id")[["Dim1", "Dim2", "Dim3"]].to_numpy()
    np.testing.assert_allclose(rows, a @ weights, atol=1e-9)
    for j in range(2):
        for k in range(3):
            assert found.continuous_coordinates[j, k] == pytest.approx(np.corrcoef(z[:, j], rows[:, k])[0, 1])
    for i in range(g.shape[1]):
        np.testing.assert_allclose(found.level_coordinates[i], rows[g[:, i] == 1].mean(axis=0), atol=1e-9)
    between = found.relationships_df(spark).toPandas()
    first = between[(between["dim"] == "Dim1")]["squared"].sum()
    assert first == pytest.approx(found.eigenvalues[0])


def test_famd_arguments(frame, personnel):
    df = frame(personnel)
    with pytest.raises(ValueError, match="continuous"):
        famd(df, ["absent"], ["grade"])
    with pytest.raises(ValueError, match="categorical"):
        famd(df, ["pay"], ["absent"])
    assert famd(df, ["pay"], ["grade"], n_components=5).n_components == 1
    gaps = frame(personnel.assign(pay=personnel["pay"].where(personnel["id"] > 3)))
    with pytest.raises(ValueError, match="missing"):
        famd(gaps, ["pay"], ["grade"])


def test_famd_keeps_a_constant_number(frame, personnel):
    found = famd(frame(personnel.assign(flat=1.0)), ["pay", "flat"], ["grade"], n_components=2)
    assert np.isfinite(found.eigenvalues).all()
    assert found.total_inertia == pytest.approx(1 + 2)


def test_row_coordinates_are_narrow(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    found = famd(df, ["l_quantity"], ["l_returnflag", "l_linestatus"], key=["l_orderkey"])
    plan = found.row_coordinates._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert "Exchange hashpartitioning" not in plan


def test_axes_that_have_not_converged_are_reported(spark, monkeypatch):
    """One round is not enough for two wide columns of little order; the result says so, and so does the audit's step."""
    from tablescope.operators import level_krylov, wide_levels
    from tablescope.plans.audit import AuditConfig, AuditResult

    df = spark.range(900).select((F.col("id") * 7919 % 97).alias("a"), (F.xxhash64("id") % 89).alias("b"))
    monkeypatch.setattr(wide_levels, "leading_axes", lambda m, n: level_krylov.leading_axes(m, n, rounds=1))
    found = mca(df, ["a", "b"], dense_levels=20)
    assert not found.converged and found.residuals.max() > 1e-4
    result = AuditResult(AuditConfig(), df, None)
    assert result.attempt("mca", lambda: found) is found
    assert result.steps[0][:2] == ("mca", "failed") and "not converged" in result.steps[0][2]
