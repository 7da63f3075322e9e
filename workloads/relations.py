"""Correlations, their p-values and the normality check."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope import TableAnalysis
from tablescope.functions.columns import filled
from tablescope.functions.normality import (
    LARGE_LOG_SD,
    LARGE_MEAN,
    LAST_WEIGHT,
    NEXT_TO_LAST_WEIGHT,
    SMALL_GAMMA,
    SMALL_LOG_SD,
    SMALL_MEAN,
)
from tablescope.functions.tables import small_table
from tablescope.operators.correlation import normality_df
from tablescope.operators.ranks import average_ranks
from tablescope.plans.chart_tables import heatmap_cells
from workloads.registry import ORDER_PROFILE, PRICE_LINES, derived, load, num, query, r, rounded

LINE_VALUES = ("quantity", "price", "net", "charge")


def pearson_cells(table: str, columns: tuple[str, ...]) -> str:
    """Full matrix in long form."""
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var_i, '{b}' AS var_j, {'CAST(any_value(1) AS DOUBLE)' if a == b else f'corr({a}, {b})'} AS r FROM ({table})"
        for a in columns
        for b in columns
    )


def ranked(table: str, columns: tuple[str, ...], keep: tuple[str, ...] = ()) -> str:
    """Average ranks: place of the first equal value plus half the further equal values."""
    ranks = [
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in columns
    ]
    return f"SELECT {', '.join([*keep, *ranks])} FROM ({table})"


@query(f"SELECT var_i, var_j, {r('r', 'r')} FROM ({pearson_cells(PRICE_LINES, LINE_VALUES)})")
def pearson_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysis = TableAnalysis(derived(spark, sf_dir, PRICE_LINES), LINE_VALUES)
    return rounded(analysis.correlation("pearson").to_df(spark).drop("p_value"))


@query(
    f"SELECT var_i, var_j, {r('r', 'r')} FROM ({pearson_cells(ranked(PRICE_LINES, LINE_VALUES), LINE_VALUES)})"
)
def spearman_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysis = TableAnalysis(derived(spark, sf_dir, PRICE_LINES), LINE_VALUES)
    return rounded(analysis.correlation("spearman").to_df(spark).drop("p_value"))


_CUSTOMER = ("c_nationkey", "c_acctbal", "c_custkey")


@query(
    f"""SELECT c_custkey AS id, {", ".join(r(c, c) for c in ("c_nationkey", "c_acctbal"))}
    FROM ({ranked("SELECT * FROM customer", ("c_nationkey", "c_acctbal"), ("c_custkey",))})"""
)
def average_rank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks stay on their rows; ties share the mean rank."""
    table = load(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    _, ranks = average_ranks(table, {c: filled(table, c) for c in ("c_nationkey", "c_acctbal")}, key=["id"])
    return rounded(ranks)


@query(
    f"""SELECT l_orderkey, l_linenumber, {", ".join(r(c, c) for c in ("quantity", "net", "charge"))}
    FROM ({ranked(PRICE_LINES, ("quantity", "net", "charge"), ("l_orderkey", "l_linenumber"))})"""
)
def joined_rank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows meet the ranks of many values by joins, frequent values dealt out; only the quantities are looked up."""
    table = derived(spark, sf_dir, PRICE_LINES)
    values = {c: filled(table, c) for c in ("quantity", "net", "charge")}
    key = ["l_orderkey", "l_linenumber"]
    _, ranks = average_ranks(table, values, key, looked_up_values=1_000, hot_rows=2)
    return rounded(ranks)


@query(
    " UNION ALL ".join(
        f"""SELECT var_i, var_j, {r('c * sqrt((n - 2) / (1 - c * c))', 't', 3)}
        FROM (SELECT '{a}' AS var_i, '{b}' AS var_j, corr({a}, {b}) AS c, count(*) AS n FROM orders)"""
        for a, b in combinations(("o_orderkey", "o_custkey", "o_totalprice"), 2)
    )
)
def correlation_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t statistic of each pair."""
    analysis = TableAnalysis(load(spark, sf_dir, "orders"))
    return rounded(analysis.correlation("pearson").t_statistics(spark), 3)


def student_sql(pairs: str) -> str:
    """Two-sided p-value for an even number of degrees of freedom: the finite cosine series of Student's law."""
    return f"""
    WITH t AS ({pairs}),
    a AS (SELECT var_i, var_j, n - 2 AS v, atan(abs(c) / sqrt(1 - c * c)) AS angle FROM t),
    s AS (SELECT var_i, var_j, any_value(angle) AS angle,
          sum(exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - j * ln(4) + 2 * j * ln(cos(angle)))) AS series
          FROM a, LATERAL (SELECT CAST(unnest(range(0, v // 2)) AS DOUBLE) AS j) GROUP BY var_i, var_j)
    SELECT var_i, var_j, {r('1 - sin(angle) * series', 'p_value', 5)} FROM s
    """


@query(
    student_sql(
        " UNION ALL ".join(
            f"SELECT '{a}' AS var_i, '{b}' AS var_j, corr({a}, {b}) AS c, count(*) AS n FROM customer"
            for a in _CUSTOMER
            for b in _CUSTOMER
            if a != b
        )
    )
)
def correlation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p-value of each pair, both ways round."""
    analysis = TableAnalysis(load(spark, sf_dir, "customer"), _CUSTOMER)
    cells = analysis.correlation("pearson").to_df(spark).where("var_i <> var_j")
    return rounded(cells.drop("r"), 5)


def _heatmap_sql(table: str, columns: tuple[str, ...]) -> str:
    """Beyond 1,000 rows a pair is significant at 5 % when |t| exceeds 1.96 (tested pairs lie far from it)."""
    pairs = " UNION ALL ".join(
        f"SELECT '{columns[i]}' AS var_i, '{columns[j]}' AS var_j, corr({columns[i]}, {columns[j]}) AS c, count(*) AS n FROM ({table})"
        for i in range(len(columns))
        for j in range(i)
    )
    return f"""SELECT var_i, var_j, {r('c', 'r')},
    CASE WHEN abs(c) * sqrt((n - 2) / (1 - c * c)) < 1.96 THEN '' ELSE printf('%.2f', c) END AS label FROM ({pairs})"""


_PROFILE = ("n_lines", "total_quantity", "total_price", "total_discount", "l_orderkey")


@query(_heatmap_sql(ranked(ORDER_PROFILE, _PROFILE), _PROFILE))
def heatmap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict lower triangle with a blank label where not significant; the method is chosen by the check."""
    analysis = TableAnalysis(derived(spark, sf_dir, ORDER_PROFILE), _PROFILE)
    return rounded(heatmap_cells(spark, analysis.correlation()).drop("p_value"))


@query(
    f"""SELECT var_i, var_j, CASE WHEN label <> '' THEN r END AS r
    FROM ({_heatmap_sql("SELECT * FROM orders", ("o_orderkey", "o_custkey", "o_totalprice"))})"""
)
def significant_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysis = TableAnalysis(load(spark, sf_dir, "orders"))
    return rounded(analysis.correlation("pearson").significant_df(spark).drop("p_value"))


# Acklam's rational approximation of the inverse normal law, highest power first; relative error 1.2e-9.
_CENTRE_OVER = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01,
    2.506628277459239e00,
)
_CENTRE_UNDER = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0,
)
_TAIL_OVER = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00,
    2.938163982698783e00,
)
_TAIL_UNDER = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
# Abramowitz and Stegun 7.1.26, erfc to 1.5e-7
_ERFC = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592, 0.0)


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    found = f"{coefficients[0]:.16e}"
    for c in coefficients[1:]:
        found = f"({found} * {x} + {c:.16e})"
    return found


def _upward(coefficients: tuple[float, ...], x: str) -> str:
    return _horner(coefficients[::-1], x)


def shapiro_sql(samples: dict[str, tuple[str, ...]]) -> str:
    """Royston's test in SQL: for each table its columns, as ``(name, variable, w, p_value, is_normal)``."""
    cells = " UNION ALL ".join(
        f"SELECT '{t}' AS name, '{c}' AS variable, CAST({c} AS DOUBLE) AS x FROM {t}" for t, cs in samples.items() for c in cs
    )
    side = "CASE WHEN q < 0.5e0 THEN 1 ELSE -1 END"
    far = "sqrt(-2 * ln(least(q, 1 - q)))"
    centre = f"(q - 0.5e0) * {_horner(_CENTRE_OVER, 'square')} / {_horner(_CENTRE_UNDER, 'square')}"
    tail = f"{side} * {_horner(_TAIL_OVER, far)} / {_horner(_TAIL_UNDER, far)}"
    mean = f"CASE WHEN n <= 11 THEN {_upward(SMALL_MEAN, 'n')} ELSE {_upward(LARGE_MEAN, 'ln(n)')} END"
    log_sd = f"CASE WHEN n <= 11 THEN {_upward(SMALL_LOG_SD, 'n')} ELSE {_upward(LARGE_LOG_SD, 'ln(n)')} END"
    erfc = _horner(_ERFC, "(1 / (1 + 0.3275911e0 * abs(z) / sqrt(2.0e0)))")
    return f"""WITH cells AS ({cells}),
    placed AS (SELECT *, row_number() OVER (PARTITION BY name, variable ORDER BY x) AS i,
               CAST(count(*) OVER (PARTITION BY name, variable) AS DOUBLE) AS n FROM cells),
    quantiles AS (SELECT *, (i - 0.375e0) / (n + 0.25e0) AS q FROM placed),
    squares AS (SELECT *, (q - 0.5e0) * (q - 0.5e0) AS square FROM quantiles),
    scores AS (SELECT *, CASE WHEN abs(q - 0.5e0) <= 0.47575e0 THEN {centre} ELSE {tail} END AS m FROM squares),
    sums AS (SELECT name, variable, any_value(n) AS n, sum(m * m) AS mm, sum(m * x) AS mx, var_pop(x) * any_value(n) AS spread,
             max(m) AS m1, max(m) FILTER (WHERE i = n - 1) AS m2, max(x) - min(x) AS reach,
             max(x) FILTER (WHERE i = n - 1) - max(x) FILTER (WHERE i = 2) AS inner_reach FROM scores GROUP BY ALL),
    ends AS (SELECT *, m1 / sqrt(mm) + {_upward(LAST_WEIGHT, '(1 / sqrt(n))')} AS a1,
             m2 / sqrt(mm) + {_upward(NEXT_TO_LAST_WEIGHT, '(1 / sqrt(n))')} AS a2 FROM sums),
    inside AS (SELECT *, (mx - m1 * reach - m2 * inner_reach)
               / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS inner_part FROM ends),
    tested AS (SELECT *, power(inner_part + a1 * reach + a2 * inner_reach, 2) / spread AS w FROM inside),
    normal AS (SELECT *, (CASE WHEN n <= 11 THEN -ln({_upward(SMALL_GAMMA, 'n')} - ln(1 - w)) ELSE ln(1 - w) END - ({mean}))
               / exp({log_sd}) AS z FROM tested),
    tails AS (SELECT *, {erfc} * exp(-z * z / 2) / 2 AS beyond FROM normal),
    found AS (SELECT *, CASE WHEN z > 0 THEN beyond ELSE 1 - beyond END AS p FROM tails)
    SELECT name, variable, CASE WHEN n <= 5000 THEN round(w, 4) END AS w, CASE WHEN n <= 5000 THEN round(p, 4) + 0.0 END AS p_value,
    n <= 5000 AND p >= 0.05 AS is_normal FROM found"""


@query(shapiro_sql({"part": ("p_size", "p_retailprice"), "supplier": ("s_acctbal", "s_nationkey")}))
def normality_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapiro-Wilk per variable on tables of at most 5,000 rows."""
    found = None
    for name, columns in (("part", ("p_size", "p_retailprice")), ("supplier", ("s_acctbal", "s_nationkey"))):
        result = TableAnalysis(load(spark, sf_dir, name), columns).correlation()
        part = normality_df(spark, result.normality).select(F.lit(name).alias("name"), "*")
        found = part if found is None else found.unionAll(part)
    return found


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, CAST(NULL AS DOUBLE) AS w, CAST(NULL AS DOUBLE) AS p_value, false AS is_normal
        FROM lineitem HAVING count(*) > 5000"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    )
)
def normality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Above 5,000 rows no test is run and no variable counts as normal."""
    result = TableAnalysis(
        load(spark, sf_dir, "lineitem"), ("l_quantity", "l_extendedprice", "l_discount")
    ).correlation()
    return normality_df(spark, result.normality)


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(*) AS n_rows, CASE WHEN count(*) > 5000 THEN 'spearman' END AS method FROM {t}"
        for t in ("orders", "lineitem", "events")
    )
)
def method_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name in ("orders", "lineitem", "events"):
        table = load(spark, sf_dir, name)
        result = TableAnalysis(table).correlation()
        rows.append((name, result.n_rows, result.method))
    return small_table(spark, rows, "name string, n_rows bigint, method string")


@query(
    """WITH long AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)
    SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(corr(CAST(a.x AS DOUBLE), CAST(b.x AS DOUBLE)), 5) + 0.0 AS r
    FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i"""
)
def pearson_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 columns."""
    table = load(spark, sf_dir, "embeddings")
    width = table.select(F.max(F.size("embedding"))).first()[0]
    wide = table.select(*[F.get("embedding", F.lit(i)).alias(f"e{i}") for i in range(width)])
    matrix = TableAnalysis(wide).correlation("pearson").matrix
    rows = [(i, j, float(matrix[i, j])) for i in range(width) for j in range(i + 1, width)]
    return small_table(spark, rows, "i int, j int, r double").select("i", "j", num("r", 5).alias("r"))
