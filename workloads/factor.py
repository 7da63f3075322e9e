"""Factor analysis. Three variables with one factor, and small-matrix tests, have closed forms in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope import TableAnalysis
from tablescope.functions.tables import small_table
from tablescope.operators.factors import adequacy
from tablescope.plans.chart_tables import loading_cells, scree
from tablescope.plans.findings import communalities, factor_adequacy, factor_members, kmo_grade
from workloads.components import NAMES, PROFILE_PCA
from workloads.registry import ORDER_PROFILE, derived, query, r, rounded

TRIAD = ("total_quantity", "total_price", "total_discount")
FOUR = (*TRIAD, "total_tax")

_TRIAD_SQL = f"""
WITH m AS (SELECT corr(total_quantity, total_price) AS r12, corr(total_quantity, total_discount) AS r13,
           corr(total_price, total_discount) AS r23, count(*) AS n FROM ({ORDER_PROFILE})),
d AS (SELECT *, 1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23 AS det FROM m),
p AS (SELECT *, (r12 - r13 * r23) / sqrt((1 - r13 * r13) * (1 - r23 * r23)) AS a12,
      (r13 - r12 * r23) / sqrt((1 - r12 * r12) * (1 - r23 * r23)) AS a13,
      (r23 - r12 * r13) / sqrt((1 - r12 * r12) * (1 - r13 * r13)) AS a23 FROM d),
k AS (SELECT *, (r12 * r12 + r13 * r13 + r23 * r23)
      / (r12 * r12 + r13 * r13 + r23 * r23 + a12 * a12 + a13 * a13 + a23 * a23) AS kmo,
      -ln(det) * (n - 1 - 11 / 6.0) AS chi2 FROM p),
l AS (SELECT 'total_quantity' AS variable, sqrt(r12 * r13 / r23) AS loading FROM k
      UNION ALL SELECT 'total_price', sqrt(r12 * r23 / r13) FROM k
      UNION ALL SELECT 'total_discount', sqrt(r13 * r23 / r12) FROM k)
"""


def _triad(spark: SparkSession, sf_dir: str) -> TableAnalysis:
    return TableAnalysis(derived(spark, sf_dir, ORDER_PROFILE), TRIAD)


@query(
    f"""{_TRIAD_SQL} SELECT {r('kmo', 'kmo')}, {r('chi2', 'bartlett_statistic', 3)}, CAST(3 AS INTEGER) AS bartlett_df,
    false AS singular, kmo >= 0.6 AND chi2 > 7.8147 AS fa_valid,
    CASE WHEN kmo >= 0.8 THEN 'excellent' WHEN kmo >= 0.7 THEN 'good' WHEN kmo >= 0.6 THEN 'acceptable' ELSE 'insufficient' END AS grade
    FROM k"""
)
def fa_adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KMO, Bartlett's statistic, the verdict and the KMO grade (7.8147 is the 5 % point for 3 degrees)."""
    found = _triad(spark, sf_dir).factor_analysis().adequacy_df(spark).withColumn("grade", kmo_grade(F.col("kmo")))
    return rounded(
        found.select("kmo", "bartlett_statistic", "bartlett_df", "singular", "fa_valid", "grade"),
        bartlett_statistic=3,
    )


_WEAK = ("o_custkey", "o_totalprice", "o_orderkey", "o_day")
_WEAK_TABLE = """
SELECT CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice, CAST(o_orderkey AS DOUBLE) AS o_orderkey,
       CAST(extract(day FROM o_orderdate) AS DOUBLE) AS o_day FROM orders
"""


def _det4(names: tuple[str, ...]) -> str:
    """Determinant of the 4 x 4 correlation matrix from its six correlations."""
    a, b, c, d, e, f = "abcdef"  # r12 r13 r14 r23 r24 r34
    return (
        f"1 - {a}*{a} - {b}*{b} - {c}*{c} - {d}*{d} - {e}*{e} - {f}*{f}"
        f" + {a}*{a}*{f}*{f} + {b}*{b}*{e}*{e} + {c}*{c}*{d}*{d}"
        f" + 2*{a}*{b}*{d} + 2*{a}*{c}*{e} + 2*{b}*{c}*{f} + 2*{d}*{e}*{f}"
        f" - 2*{a}*{b}*{e}*{f} - 2*{a}*{c}*{d}*{f} - 2*{b}*{c}*{d}*{e}"
    )


@query(
    f"""WITH m AS (SELECT corr(o_custkey, o_totalprice) AS a, corr(o_custkey, o_orderkey) AS b, corr(o_custkey, o_day) AS c,
        corr(o_totalprice, o_orderkey) AS d, corr(o_totalprice, o_day) AS e, corr(o_orderkey, o_day) AS f, count(*) AS n
        FROM ({_WEAK_TABLE})),
    x AS (SELECT -ln({_det4(_WEAK)}) * (n - 1 - 13 / 6.0) AS chi2 FROM m)
    SELECT {r('chi2', 'statistic', 4)}, CAST(6 AS INTEGER) AS df, {r('exp(-chi2 / 2) * (1 + chi2 / 2 + chi2 * chi2 / 8)', 'p_value', 5)} FROM x"""
)
def bartlett_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly unrelated variables: the p-value with 6 degrees of freedom is a finite sum."""
    moments = TableAnalysis(derived(spark, sf_dir, _WEAK_TABLE), _WEAK).moments
    _, test = adequacy(moments)
    row = (test.statistic, test.df, test.p_value)
    return rounded(small_table(spark, [row], "statistic double, df int, p_value double"), 5, statistic=4)


@query(f"{_TRIAD_SQL} SELECT variable, {r('loading', 'loading', 5)} FROM l")
def fa_one_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variables, one factor: the squared loading is r12 r13 / r23."""
    found = _triad(spark, sf_dir).factor_analysis(n_factors=1)
    return rounded(found.loadings_df(spark).select("variable", "loading"), 5)


@query(
    f"""WITH RECURSIVE m AS (SELECT {", ".join(
        f"corr({FOUR[i]}, {FOUR[j]}) AS r{i + 1}{j + 1}" for i in range(4) for j in range(i + 1, 4))} FROM ({ORDER_PROFILE})),
    step(k, l1, l2, l3, l4) AS (
        SELECT 0, 0.8e0, 0.8e0, 0.8e0, 0.8e0
        UNION ALL
        SELECT k + 1, (l1 + (r12 * l2 + r13 * l3 + r14 * l4) / (l2 * l2 + l3 * l3 + l4 * l4)) / 2,
               (l2 + (r12 * l1 + r23 * l3 + r24 * l4) / (l1 * l1 + l3 * l3 + l4 * l4)) / 2,
               (l3 + (r13 * l1 + r23 * l2 + r34 * l4) / (l1 * l1 + l2 * l2 + l4 * l4)) / 2,
               (l4 + (r14 * l1 + r24 * l2 + r34 * l3) / (l1 * l1 + l2 * l2 + l3 * l3)) / 2
        FROM step, m WHERE k < 400),
    f AS (SELECT * FROM step WHERE k = 400)
    {" UNION ALL ".join(
        f"SELECT '{v}' AS variable, {r(f'l{i + 1}', 'loading', 5)}, {r(f'l{i + 1} * l{i + 1}', 'communality', 5)} FROM f"
        for i, v in enumerate(FOUR))}"""
)
def fa_minimum_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four variables, one factor: the oracle iterates the stationary equations of the squared residuals."""
    found = TableAnalysis(derived(spark, sf_dir, ORDER_PROFILE), FOUR).factor_analysis(n_factors=1)
    loadings = found.loadings_df(spark).select("variable", "loading")
    return rounded(loadings.join(found.communalities_df(spark), "variable"), 5)


@query(
    f"""{_TRIAD_SQL} SELECT variable, {r('loading * loading', 'communality', 5)},
    CASE WHEN loading * loading >= 0.5 THEN 'good' WHEN loading * loading >= 0.3 THEN 'medium' ELSE 'weak' END AS quality,
    loading * loading < 0.3 AS poorly_represented FROM l"""
)
def fa_communalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(communalities(spark, _triad(spark, sf_dir).factor_analysis(n_factors=1)), 5)


@query(f"WITH {PROFILE_PCA} SELECT k AS rank, {r('l', 'eigenvalue')}, l > 1 AS above_one FROM v")
def fa_scree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues with the Kaiser line."""
    analysis = TableAnalysis(derived(spark, sf_dir, ORDER_PROFILE), NAMES)
    return rounded(scree(spark, analysis.factor_analysis()))


@query(
    f"""WITH {PROFILE_PCA} SELECT CAST(greatest(1, count(*) FILTER (WHERE l > 1)) AS INTEGER) AS n_factors, 'kaiser' AS rule FROM v
    UNION ALL SELECT 2, 'manual'"""
)
def fa_factor_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kaiser's rule, and a requested count cut to one less than the variables."""
    analysis = TableAnalysis(derived(spark, sf_dir, ORDER_PROFILE), NAMES)
    found = [analysis.factor_analysis(), analysis.factor_analysis(n_factors=10)]
    return small_table(spark, [(f.n_factors, f.factor_rule) for f in found], "n_factors int, rule string")


@query(
    f"""{_TRIAD_SQL} SELECT variable, 'F1' AS factor, {r('loading', 'loading', 4)}, abs(loading) >= 0.4 AS strong,
    CAST(round(loading, 2) AS VARCHAR) AS label, 'Factor loadings, varimax rotation' AS title FROM l"""
)
def fa_loading_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = loading_cells(spark, _triad(spark, sf_dir).factor_analysis(n_factors=1))
    return rounded(found, 4)


@query(
    f"""{_TRIAD_SQL} SELECT 'F1' AS component, string_agg(variable, ',' ORDER BY abs(loading) DESC) AS variables
    FROM l WHERE abs(loading) > 0.4"""
)
def fa_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables above 0.4 on each factor, strongest first."""
    found = factor_members(_triad(spark, sf_dir).factor_analysis(n_factors=1).loadings_df(spark))
    return found.withColumn("variables", F.array_join("variables", ","))


@query(
    f"""{_TRIAD_SQL} SELECT 'kmo' AS topic, printf('%.3f', kmo) AS value, CASE WHEN kmo >= 0.7 THEN 'good adequacy'
        WHEN kmo >= 0.6 THEN 'acceptable adequacy' ELSE 'weak adequacy' END AS verdict FROM k
    UNION ALL SELECT 'bartlett', CASE WHEN chi2 > 25 THEN '0.0000' END,
        CASE WHEN chi2 > 7.8147 THEN 'significant correlations' ELSE 'no significant correlations' END FROM k
    UNION ALL SELECT 'rotation', 'promax', 'factors may be correlated'"""
)
def fa_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_adequacy(spark, _triad(spark, sf_dir).factor_analysis(rotation="promax"))


@query(
    f"""{_TRIAD_SQL} SELECT 'flat' AS dropped, {r('kmo', 'kmo')}, {r('(SELECT min(loading) FROM l)', 'weakest', 5)} FROM k"""
)
def fa_constant_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column without spread leaves the analysis and is named."""
    table = derived(spark, sf_dir, ORDER_PROFILE).withColumn("flat", F.lit(3.5))
    found = TableAnalysis(table, (*TRIAD, "flat")).factor_analysis(n_factors=1)
    row = (",".join(found.dropped), found.kmo_score, float(found.loadings.min()))
    return rounded(small_table(spark, [row], "dropped string, kmo double, weakest double"), weakest=5)


_STRUCTURE = (*FOUR, "l_orderkey", "n_lines")


@query()
def fa_varimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rotated factors with communalities."""
    found = TableAnalysis(derived(spark, sf_dir, ORDER_PROFILE), _STRUCTURE).factor_analysis(n_factors=2)
    return rounded(found.loadings_df(spark).join(found.communalities_df(spark), "variable"))


@query()
def fa_promax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two oblique factors with their correlation."""
    found = TableAnalysis(derived(spark, sf_dir, ORDER_PROFILE), _STRUCTURE).factor_analysis(2, "promax")
    between = F.lit(float(found.factor_correlations[0, 1])).alias("factor_correlation")
    return rounded(found.loadings_df(spark).select("*", between))


# Two factors with known loadings: f from the customers, g and six errors from signs that are crossed with them. Of three signs
# a, b, c the seven products are uncorrelated, so the loadings of a column are its weights of f and g over its deviation,
# the residual correlations are exactly 0, and only the rotation is left to be found.
_WEIGHTS = {
    "u1": (0.9, 0.3, 0.5), "u2": (0.8, -0.2, 0.6), "u3": (0.7, 0.5, 0.4),
    "v1": (0.2, 0.9, 0.5), "v2": (-0.3, 0.8, 0.6), "v3": (0.4, 0.7, 0.7),
}
_SIGNS = " ".join(f"CROSS JOIN (SELECT 1.0e0 AS {x} UNION ALL SELECT -1.0e0 AS {x}) sign_{x}" for x in "abc")
TWO_FACTORS = f"""
SELECT c_custkey, {", ".join(
    f"{f}e0 * c_acctbal * 0.0003e0 + {g}e0 * a + {own}e0 * {error} AS {name}"
    for (name, (f, g, own)), error in zip(_WEIGHTS.items(), ("b", "c", "(a * b)", "(a * c)", "(b * c)", "(a * b * c)")))}
FROM customer {_SIGNS}
"""

# Kaiser's angle for two factors is closed: rows of unit length, u and v the cosine and sine of twice their angles.
_KAISER = f"""
m AS (SELECT stddev_pop(c_acctbal * 0.0003e0) AS s FROM customer),
mix AS ({" UNION ALL ".join(
    f"SELECT '{name}' AS variable, {f}e0 AS f, {g}e0 AS g, {own}e0 AS own" for name, (f, g, own) in _WEIGHTS.items())}),
known AS (SELECT variable, f * s / sqrt(f * f * s * s + g * g + own * own) AS x, g / sqrt(f * f * s * s + g * g + own * own) AS y
          FROM mix, m),
uv AS (SELECT (x * x - y * y) / (x * x + y * y) AS u, 2 * x * y / (x * x + y * y) AS v FROM known),
angle AS (SELECT atan2(2 * sum(u * v) - 2 * sum(u) * sum(v) / count(*),
          sum(u * u - v * v) - (sum(u) * sum(u) - sum(v) * sum(v)) / count(*)) / 4 AS t FROM uv),
turned AS (SELECT variable, x * cos(t) + y * sin(t) AS p, y * cos(t) - x * sin(t) AS q FROM known, angle),
sizes AS (SELECT sum(p * p) >= sum(q * q) AS in_order, sign(sum(p)) AS sp, sign(sum(q)) AS sq FROM turned),
simple AS (SELECT variable, CASE WHEN in_order THEN p * sp ELSE q * sq END AS p,
           CASE WHEN in_order THEN q * sq ELSE p * sp END AS q FROM turned, sizes)
"""


def _two_factors(spark: SparkSession, sf_dir: str, rotation: str):
    table = derived(spark, sf_dir, TWO_FACTORS)
    return TableAnalysis(table, tuple(_WEIGHTS)).factor_analysis(n_factors=2, rotation=rotation)


@query(
    f"""WITH {_KAISER} SELECT variable, 'F1' AS component, {r('p', 'loading', 5)}, {r('p * p + q * q', 'communality', 5)} FROM simple
    UNION ALL SELECT variable, 'F2', {r('q', 'loading', 5)}, {r('p * p + q * q', 'communality', 5)} FROM simple"""
)
def fa_two_varimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two factors turned to simple structure; the oracle turns the known loadings by Kaiser's angle."""
    found = _two_factors(spark, sf_dir, "varimax")
    loadings = found.loadings_df(spark).select("variable", "component", "loading")
    return rounded(loadings.join(found.communalities_df(spark), "variable"), 5)


@query(
    f"""WITH {_KAISER},
    t AS (SELECT *, sign(p) * power(p, 4) AS tp, sign(q) * power(q, 4) AS tq FROM simple),
    h AS (SELECT sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * tp) AS h11, sum(p * tq) AS h12,
          sum(q * tp) AS h21, sum(q * tq) AS h22 FROM t),
    fit AS (SELECT (qq * h11 - pq * h21) / (pp * qq - pq * pq) AS a, (qq * h12 - pq * h22) / (pp * qq - pq * pq) AS b,
            (pp * h21 - pq * h11) / (pp * qq - pq * pq) AS c, (pp * h22 - pq * h12) / (pp * qq - pq * pq) AS d FROM h),
    unit AS (SELECT a * e AS a, c * e AS c, b * g AS b, d * g AS d FROM (SELECT *, sqrt(b * b + d * d) / abs(a * d - b * c) AS e,
             sqrt(a * a + c * c) / abs(a * d - b * c) AS g FROM fit)),
    oblique AS (SELECT variable, p * a + q * c AS p, p * b + q * d AS q,
                -(c * d + a * b) / power(a * d - b * c, 2) AS between_factors FROM simple, unit),
    places AS (SELECT sum(p * p) >= sum(q * q) AS in_order, sign(sum(p)) AS sp, sign(sum(q)) AS sq FROM oblique),
    final AS (SELECT variable, CASE WHEN in_order THEN p * sp ELSE q * sq END AS p,
              CASE WHEN in_order THEN q * sq ELSE p * sp END AS q, between_factors * sp * sq AS between_factors FROM oblique, places)
    SELECT variable, 'F1' AS component, {r('p', 'loading', 5)}, {r('between_factors', 'factor_correlation', 5)} FROM final
    UNION ALL SELECT variable, 'F2', {r('q', 'loading', 5)}, {r('between_factors', 'factor_correlation', 5)} FROM final"""
)
def fa_two_promax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two oblique factors and their correlation; the oracle fits the powered loadings with 2 x 2 algebra."""
    found = _two_factors(spark, sf_dir, "promax")
    between = F.lit(float(found.factor_correlations[0, 1])).alias("factor_correlation")
    return rounded(found.loadings_df(spark).select("variable", "component", "loading", between), 5)
