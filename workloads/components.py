"""Principal components. With three variables everything has a closed form that plain SQL can compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope import TableAnalysis
from tablescope.functions.tables import small_table
from tablescope.operators.pca import ordered_eigen, top_variables
from tablescope.plans.chart_tables import biplot_arrows, variance_curve
from tablescope.plans.chart_tables import biplot_points as display_points
from tablescope.plans.findings import component_summary, rounded as display_rounded
from workloads.registry import ORDER_PROFILE, PRICE_LINES, derived, load, query, r, rounded

NAMES = ("n_lines", "total_quantity", "total_price")


def three_variable_pca(table: str, names: tuple[str, str, str]) -> str:
    """CTEs ``m`` (means, deviations, correlations), ``e`` (eigenvalues l1 > l2 > l3) and ``v`` (eigenvectors).

    The characteristic cubic of a 3 x 3 correlation matrix is solved by cosines; an eigenvector is the cross
    product of two rows of R - lambda I, scaled to length 1, its largest entry positive.
    """
    x, y, z = names
    return f"""
    t AS ({table}),
    m AS (SELECT avg({x}) AS m1, avg({y}) AS m2, avg({z}) AS m3, stddev_pop({x}) AS s1, stddev_pop({y}) AS s2,
          stddev_pop({z}) AS s3, corr({x}, {y}) AS r12, corr({x}, {z}) AS r13, corr({y}, {z}) AS r23, count(*) AS n FROM t),
    c AS (SELECT *, r12 * r12 + r13 * r13 + r23 * r23 AS s, r12 * r13 * r23 AS h FROM m),
    e AS (SELECT k, 1 + 2 * sqrt(s / 3) * cos(acos(3 * h / s * sqrt(3 / s)) / 3 - 2 * pi() * (k - 1) / 3) AS l,
          r12, r13, r23 FROM c, (VALUES (1), (2), (3)) AS ks(k)),
    w AS (SELECT k, l, r12 * r23 - r13 * (1 - l) AS a, r13 * r12 - (1 - l) * r23 AS b, (1 - l) * (1 - l) - r12 * r12 AS c FROM e),
    u AS (SELECT k, l, a / sqrt(a * a + b * b + c * c) AS a, b / sqrt(a * a + b * b + c * c) AS b,
          c / sqrt(a * a + b * b + c * c) AS c FROM w),
    g AS (SELECT *, CASE WHEN abs(a) >= greatest(abs(b), abs(c)) THEN sign(a) WHEN abs(b) >= abs(c) THEN sign(b)
          ELSE sign(c) END AS flip FROM u),
    v AS (SELECT CAST(k AS INTEGER) AS k, l, a * flip AS v1, b * flip AS v2, c * flip AS v3 FROM g),
    shares AS (SELECT k, l, l / 3 AS explained, sum(l) OVER (ORDER BY k) / 3 AS cumulative FROM v),
    chosen AS (SELECT greatest(2, min(k)) AS kept FROM shares WHERE cumulative >= 0.8),
    loadings AS (
        SELECT 'PC' || k AS component, '{x}' AS variable, 0 AS position, v1 AS loading FROM v, chosen WHERE k <= kept
        UNION ALL SELECT 'PC' || k, '{y}', 1, v2 FROM v, chosen WHERE k <= kept
        UNION ALL SELECT 'PC' || k, '{z}', 2, v3 FROM v, chosen WHERE k <= kept),
    scores AS (SELECT t.*, {", ".join(
        f"({x} - m1) / s1 * v{k}.v1 + ({y} - m2) / s2 * v{k}.v2 + ({z} - m3) / s3 * v{k}.v3 AS pc{k}" for k in (1, 2)
    )} FROM t, m, v v1, v v2 WHERE v1.k = 1 AND v2.k = 2),
    top AS (SELECT component, CAST(row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, position) AS INTEGER) AS rank,
        variable, loading, variable || ' (' || printf('%+.3f', loading) || ')' AS label FROM loadings)
    """


PROFILE_PCA = three_variable_pca(ORDER_PROFILE, NAMES)


def _analysis(spark: SparkSession, sf_dir: str) -> TableAnalysis:
    return TableAnalysis(derived(spark, sf_dir, ORDER_PROFILE), NAMES, key=["l_orderkey"])


@query(
    f"""WITH {PROFILE_PCA} SELECT k AS component, {r('l', 'eigenvalue')}, {r('explained', 'explained')},
    {r('cumulative', 'cumulative')}, k <= kept AS kept FROM shares, chosen"""
)
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explained and cumulative share of every component, and which are kept."""
    return rounded(_analysis(spark, sf_dir).pca().variance_df(spark))


@query(
    f"""WITH {PROFILE_PCA} SELECT CAST(kept AS INTEGER) AS n_components,
    CAST((SELECT min(k) FROM shares WHERE cumulative >= 0.8) AS INTEGER) AS n_components_80pct, true AS reached FROM chosen"""
)
def pca_component_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First components reaching 80 %, at least two."""
    found = _analysis(spark, sf_dir).pca()
    row = (found.n_components, found.n_components_80pct, found.variance_threshold_reached)
    return small_table(spark, [row], "n_components int, n_components_80pct int, reached boolean")


@query(f"WITH {PROFILE_PCA} SELECT variable, component, {r('loading', 'loading')} FROM loadings")
def pca_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_analysis(spark, sf_dir).pca().loadings_df(spark).drop("position"))


@query(f"WITH {PROFILE_PCA} SELECT l_orderkey, {r('pc1', 'PC1', 5)}, {r('pc2', 'PC2', 5)} FROM scores")
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row."""
    return rounded(_analysis(spark, sf_dir).pca().scores, 5)


@query(f"WITH {PROFILE_PCA} SELECT component, rank, variable, {r('loading', 'loading')}, label FROM top WHERE rank <= 2")
def pca_top_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(top_variables(_analysis(spark, sf_dir).pca().loadings_df(spark), 2))


@query(
    f"""WITH {PROFILE_PCA} SELECT '#' || a.rank AS rank, a.label AS "PC1", b.label AS "PC2"
    FROM top a JOIN top b ON a.rank = b.rank WHERE a.component = 'PC1' AND b.component = 'PC2'"""
)
def pca_top_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More places asked for than variables: the table has one row per variable."""
    analysis = _analysis(spark, sf_dir)
    return analysis.top_variables(analysis.pca(), 5)


@query(
    f"""WITH {PROFILE_PCA} SELECT k AS component, {r('cumulative * 100', 'cumulative_pct', 4)},
    CAST(80.0 AS DOUBLE) AS threshold_pct, k = kept AS selected FROM shares, chosen"""
)
def variance_curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(variance_curve(spark, _analysis(spark, sf_dir).pca()), 4)


@query(
    f"""WITH {PROFILE_PCA}, scale AS (SELECT 0.9 * greatest(max(abs(pc1)), max(abs(pc2))) AS s FROM scores),
    arrows AS (SELECT variable, max(CASE WHEN component = 'PC1' THEN loading * s END) AS x,
               max(CASE WHEN component = 'PC2' THEN loading * s END) AS y FROM loadings, scale GROUP BY variable)
    SELECT variable, {r('x', 'x', 4)}, {r('y', 'y', 4)}, {r('x * 1.07', 'label_x', 4)}, {r('y * 1.07', 'label_y', 4)} FROM arrows"""
)
def biplot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable arrows scaled by the largest score of any row on any kept component."""
    return rounded(biplot_arrows(spark, _analysis(spark, sf_dir).pca()), 4)


@query(
    f"""WITH {PROFILE_PCA} SELECT l_orderkey, {r('pc1', 'PC1', 5)}, {r('pc2', 'PC2', 5)} FROM scores
    ORDER BY md5(CAST(l_orderkey AS VARCHAR)), l_orderkey LIMIT 2000"""
)
def biplot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for display: a sample of fixed size, the same on any partitions."""
    return rounded(display_points(_analysis(spark, sf_dir).pca()), 5)


@query(
    f"""WITH {PROFILE_PCA} SELECT 'PC' || k AS component, printf('%.1f%%', explained * 100) AS explained,
    (SELECT string_agg(label, ', ' ORDER BY rank) FROM top WHERE component = 'PC' || k) AS variables
    FROM shares, chosen WHERE k <= kept"""
)
def pca_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each kept component and its strongest variables."""
    found = component_summary(spark, _analysis(spark, sf_dir).pca())
    return found.withColumn("variables", F.array_join("variables", ", "))


@query(f"WITH {PROFILE_PCA} SELECT variable, CAST(position AS INTEGER) AS position, component, {r('loading', 'loading', 3)} FROM loadings")
def display_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result table rounded to 3 decimals for display."""
    return rounded(display_rounded(_analysis(spark, sf_dir).pca().loadings_df(spark), 3), 3)


LINE_NAMES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey")


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS var_i, '{b}' AS var_j, {r('any_value(1)' if a == b else f'corr({a}, {b})', 'r')} FROM lineitem"
        for a in LINE_NAMES
        for b in LINE_NAMES
    )
)
def pca_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues and eigenvectors of six variables give the correlation matrix back."""
    moments = TableAnalysis(load(spark, sf_dir, "lineitem"), LINE_NAMES).moments
    values, vectors = ordered_eigen(moments.standardized_cov())
    back = vectors * values @ vectors.T
    rows = [(a, b, float(back[i, j])) for i, a in enumerate(LINE_NAMES) for j, b in enumerate(LINE_NAMES)]
    return rounded(small_table(spark, rows, "var_i string, var_j string, r double"))


@query(
    f"""SELECT CAST(4 AS DOUBLE) AS total, {r(
        "4 + 2 * (" + " + ".join(f"power(corr({a}, {b}), 2)" for a, b in (
            ("quantity", "price"), ("quantity", "net"), ("quantity", "charge"), ("price", "net"),
            ("price", "charge"), ("net", "charge"))) + ")", "squares")} FROM ({PRICE_LINES})"""
)
def pca_eigen_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and squared sum of the eigenvalues of four strongly related variables."""
    found = TableAnalysis(derived(spark, sf_dir, PRICE_LINES), ("quantity", "price", "net", "charge")).pca()
    values = found.eigenvalues
    return rounded(small_table(spark, [(float(values.sum()), float((values**2).sum()))], "total double, squares double"))


@query(
    f"""WITH t AS ({PRICE_LINES}), m AS (SELECT avg(quantity) AS m1, stddev_pop(quantity) AS s1, avg(price) AS m2,
        stddev_pop(price) AS s2, sign(corr(quantity, price)) AS g FROM t)
    SELECT l_orderkey, l_linenumber, {r('((quantity - m1) / s1 + g * (price - m2) / s2) / sqrt(2)', 'PC1', 5)},
    {r('((quantity - m1) / s1 - g * (price - m2) / s2) / sqrt(2)', 'PC2', 5)} FROM t, m"""
)
def pca_scores_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variables: both components are the scaled sum and difference."""
    table = derived(spark, sf_dir, PRICE_LINES)
    return rounded(TableAnalysis(table, ("quantity", "price"), key=["l_orderkey", "l_linenumber"]).pca().scores, 5)
