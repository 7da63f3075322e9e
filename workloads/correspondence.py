"""Multiple correspondence analysis. A variable with 3 and one with 2 levels have one axis, in closed form."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.columns import level_text
from tablescope.functions.tables import small_table
from tablescope.operators.levels import burt_table
from tablescope.operators.mca import mca
from tablescope.operators.nearest import closest_pairs
from tablescope.plans.findings import closest_levels, level_extremes
from workloads.components import three_variable_pca
from workloads.registry import BAND_LINES, derived, load, num, query, r, rounded

KEY = ("l_orderkey", "l_linenumber")

# a: 3 levels, b: 2 levels. The table of both has one canonical correlation s = sqrt(chi2 / n); the axis has
# eigenvalue (1 + s) / 2 and standard coordinates g. Its sign makes the largest |g| * sqrt(mass) positive.
TWO_VARIABLE_MCA = f"""
t AS ({BAND_LINES}),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM t),
pa AS (SELECT price_band AS a, count(*) / any_value(n) AS p FROM t, n GROUP BY 1),
pb AS (SELECT net_band AS b, count(*) / any_value(n) AS p FROM t, n GROUP BY 1),
ab AS (SELECT price_band AS a, net_band AS b, count(*) / any_value(n) AS p FROM t, n GROUP BY 1, 2),
grid AS (SELECT pa.a, pb.b, pa.p AS qa, pb.p AS qb, coalesce(ab.p, 0) AS p FROM pa CROSS JOIN pb
         LEFT JOIN ab ON ab.a = pa.a AND ab.b = pb.b),
s AS (SELECT sqrt(sum((p - qa * qb) * (p - qa * qb) / (qa * qb))) AS s FROM grid),
gb AS (SELECT b, p, CASE WHEN b = 'large' THEN sqrt((1 - p) / p) ELSE -sqrt((1 - p) / p) END AS g FROM pb),
ga AS (SELECT grid.a, any_value(qa) AS p, sum(grid.p / qa * gb.g) / any_value(s.s) AS g
       FROM grid JOIN gb ON gb.b = grid.b, s GROUP BY grid.a),
raw AS (SELECT 'price_band' AS variable, a AS level, p, g FROM ga UNION ALL SELECT 'net_band', b, p, g FROM gb),
flip AS (SELECT sign(arg_max(g, abs(g) * sqrt(p))) AS f FROM raw),
standard AS (SELECT variable, level, p / 2 AS mass, g * f AS g FROM raw, flip),
axis AS (SELECT (1 + s) / 2 AS l FROM s),
coordinates AS (SELECT variable, level, 'Dim1' AS dim, g * sqrt(l) AS coordinate, mass FROM standard, axis)
"""


def _bands(spark: SparkSession, sf_dir: str, **options):
    return mca(derived(spark, sf_dir, BAND_LINES), ("price_band", "net_band"), **options)


@query(f"WITH {TWO_VARIABLE_MCA} SELECT variable, level, dim, {r('coordinate', 'coordinate')}, {r('mass', 'mass')} FROM coordinates")
def mca_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_bands(spark, sf_dir).levels_df(spark))


@query(
    f"""WITH {TWO_VARIABLE_MCA} SELECT l_orderkey, l_linenumber, {r('(x.g + y.g) / 2', 'Dim1')}
    FROM t JOIN standard x ON x.variable = 'price_band' AND x.level = price_band
    JOIN standard y ON y.variable = 'net_band' AND y.level = net_band"""
)
def mca_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of every row."""
    return rounded(_bands(spark, sf_dir, key=KEY).row_coordinates)


@query(
    f"""WITH {TWO_VARIABLE_MCA} SELECT 'Dim1' AS dim, {r('l', 'eigenvalue', 4)}, {r('l / 1.5 * 100', 'inertia_pct', 2)},
    {r('l / 1.5 * 100', 'cumulative_pct', 2)} FROM axis"""
)
def mca_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five levels of two variables hold an inertia of 5 / 2 - 1."""
    return rounded(_bands(spark, sf_dir).inertia_df(spark))


@query(
    f"""WITH {TWO_VARIABLE_MCA} SELECT 'Dim1' AS dim, {r('l', 'eigenvalue', 4)}, CAST(100 AS DOUBLE) AS inertia_pct,
    CAST(100 AS DOUBLE) AS cumulative_pct FROM axis"""
)
def mca_inertia_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares among the kept axes only."""
    return rounded(_bands(spark, sf_dir, inertia_basis="kept").inertia_df(spark))


@query(f"WITH {TWO_VARIABLE_MCA} SELECT {r('power(2 * l - 1, 2)', 'association')} FROM axis")
def mca_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With two variables the axis gives chi-square over rows."""
    found = _bands(spark, sf_dir)
    return rounded(small_table(spark, [(float((2 * found.eigenvalues[0] - 1) ** 2),)], "association double"))


# The orders, thousands of levels, against two bands: the only canonical correlation s is the square root of the variance
# of the share of 'large' between orders over p (1 - p).
MANY_LEVELS = f"""
t AS ({BAND_LINES}),
p AS (SELECT avg(CASE WHEN net_band = 'large' THEN 1.0e0 ELSE 0.0e0 END) AS p FROM t),
g AS (SELECT l_orderkey, avg(CASE WHEN net_band = 'large' THEN 1.0e0 ELSE 0.0e0 END) AS a, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT sqrt(sum(n * (a - p) * (a - p)) / sum(n) / any_value(p * (1 - p))) AS s FROM g, p),
ga AS (SELECT l_orderkey, n, (a - p) / sqrt(p * (1 - p)) / s AS g FROM g, p, s),
gb AS (SELECT 'large' AS b, sqrt((1 - p) / p) AS g, p AS share FROM p
       UNION ALL SELECT 'small', -sqrt(p / (1 - p)), 1 - p FROM p),
flip AS (SELECT sign(arg_max(g, abs(g) * sqrt(share))) AS f FROM gb)
"""


@query(
    f"""WITH {MANY_LEVELS} SELECT t.l_orderkey, l_linenumber, {r('(ga.g + gb.g) / 2 * f', 'Dim1', 5)},
    {r('(1 + s) / 2', 'eigenvalue')}
    FROM t JOIN ga ON ga.l_orderkey = t.l_orderkey JOIN gb ON gb.b = net_band, flip, s"""
)
def mca_many_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of every row with the orders as levels of one variable."""
    found = mca(derived(spark, sf_dir, BAND_LINES), ("l_orderkey", "net_band"), key=KEY)
    rows = found.row_coordinates.withColumn("eigenvalue", F.lit(float(found.eigenvalues[0])))
    return rounded(rows, 5, eigenvalue=6)


FOUR_WAY = ("price_band", "net_band", "l_returnflag", "l_linestatus")


@query(
    f"""SELECT CAST(count(DISTINCT price_band) + count(DISTINCT net_band) + count(DISTINCT l_returnflag)
    + count(DISTINCT l_linestatus) AS INTEGER) AS n_levels, {r('''(count(DISTINCT price_band) + count(DISTINCT net_band)
    + count(DISTINCT l_returnflag) + count(DISTINCT l_linestatus)) / 4.0 - 1''', 'total_inertia')},
    {r('''(count(DISTINCT price_band) + count(DISTINCT net_band)
    + count(DISTINCT l_returnflag) + count(DISTINCT l_linestatus)) / 4.0 - 1''', 'eigenvalue_sum')} FROM ({BAND_LINES})"""
)
def mca_total_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eigenvalues of four variables add up to levels / variables - 1."""
    found = mca(derived(spark, sf_dir, BAND_LINES), FOUR_WAY)
    row = (found.n_levels, found.total_inertia, float(found.all_eigenvalues.sum()))
    return rounded(small_table(spark, [row], "n_levels int, total_inertia double, eigenvalue_sum double"))


def _burt_sql(table: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS var_a, CAST({a} AS VARCHAR) AS level_a, '{b}' AS var_b, CAST({b} AS VARCHAR) AS level_b,
        count(*) AS rows FROM ({table}) GROUP BY {a}, {b}"""
        for a, b in combinations(columns, 2)
    )


@query(_burt_sql("SELECT * FROM lineitem", ("l_returnflag", "l_linestatus", "l_linenumber", "l_discount")))
def burt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per pair of levels; numbers count as text levels."""
    table = load(spark, sf_dir, "lineitem")
    return burt_table(table, ("l_returnflag", "l_linestatus", "l_linenumber", "l_discount"))


@query(
    _burt_sql(
        "SELECT p_brand, p_type, p_name, p_size FROM part", ("p_brand", "p_type", "p_name", "p_size")
    )
)
def burt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burt_table(load(spark, sf_dir, "part"), ("p_brand", "p_type", "p_name", "p_size"))


LABEL_LEVELS = """
SELECT d.doc_id, CAST(quality AS DOUBLE) AS quality, n_chars > 1000 AS is_long, n_chars * 1000000.0e0 AS big
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


@query(
    f"""SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'nan') AS quality, CASE WHEN is_long THEN 'True' ELSE 'False' END AS is_long,
    CAST(CAST(big AS BIGINT) AS VARCHAR) || '.0' AS big FROM ({LABEL_LEVELS})"""
)
def level_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells are a level of their own; large whole doubles print plainly."""
    table = derived(spark, sf_dir, LABEL_LEVELS)
    return table.select("doc_id", *[level_text(table, c).alias(c) for c in ("quality", "is_long", "big")])


@query(
    f"""WITH {TWO_VARIABLE_MCA}, named AS (SELECT variable || '=' || level AS name, coordinate FROM coordinates)
    SELECT 'Dim1' AS dim, arg_min(name, coordinate) AS lowest, {r('min(coordinate)', 'lowest_coordinate')},
    arg_max(name, coordinate) AS highest, {r('max(coordinate)', 'highest_coordinate')} FROM named"""
)
def mca_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which levels an axis opposes."""
    return rounded(level_extremes(_bands(spark, sf_dir).levels_df(spark)))


@query(
    f"""WITH {TWO_VARIABLE_MCA}, named AS (SELECT variable || '=' || level AS name, coordinate FROM coordinates)
    SELECT least(x.name, y.name) AS one, greatest(x.name, y.name) AS other, {r('abs(x.coordinate - y.coordinate)', 'distance')}
    FROM named x JOIN named y ON x.name < y.name ORDER BY abs(x.coordinate - y.coordinate) LIMIT 3"""
)
def mca_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three closest level pairs."""
    found = closest_levels(spark, _bands(spark, sf_dir), 3)
    return found.select(
        F.least("level_a", "level_b").alias("one"),
        F.greatest("level_a", "level_b").alias("other"),
        num("distance").alias("distance"),
    )


@query(
    f"""WITH {MANY_LEVELS},
    named AS (SELECT 'l_orderkey=' || l_orderkey AS name, g FROM ga UNION ALL SELECT 'net_band=' || b, g FROM gb),
    placed AS (SELECT name, round(g * f * sqrt((1 + s) / 2), 9) AS at FROM named, flip, s)
    SELECT x.name AS level_a, y.name AS level_b, 0.0e0 AS distance FROM placed x JOIN placed y ON x.at = y.at AND x.name < y.name
    ORDER BY 1, 2 LIMIT 12"""
)
def mca_closest_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest pairs of thousands of levels: orders with the same share of large lines lie at one place."""
    found = mca(derived(spark, sf_dir, BAND_LINES), ("l_orderkey", "net_band"))
    return rounded(closest_levels(spark, found, 12))


ORDER_POINTS = """
SELECT CAST(o_orderkey AS STRING) AS name, o_totalprice / 1000 AS price,
       (year(o_orderdate) * 366 + dayofyear(o_orderdate)) * 0.01e0 AS placed
FROM orders
"""


@query(
    f"""WITH p AS ({ORDER_POINTS}),
    d AS (SELECT x.name AS name_a, y.name AS name_b,
          sqrt((x.price - y.price) * (x.price - y.price) + (x.placed - y.placed) * (x.placed - y.placed)) AS distance
          FROM p x JOIN p y ON x.name < y.name)
    SELECT name_a, name_b, {r('distance', 'distance')} FROM (SELECT * FROM d ORDER BY distance, name_a, name_b LIMIT 25)"""
)
def closest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest of all pairs of orders on two axes."""
    points = derived(spark, sf_dir, ORDER_POINTS).select("name", F.array("price", "placed").alias("at"))
    return rounded(closest_pairs(points, 2, 25))


def three_way(names: tuple[str, str, str], rows: str) -> str:
    """CTEs of the axes of three two-level columns: those of their standardised indicators, the scores over sqrt 3.

    The sign makes the largest entry over all six levels positive.
    """
    entries = ", ".join(f"v{i} * sqrt(1 - m{i}), -v{i} * sqrt(m{i})" for i in (1, 2, 3))
    return f"""{three_variable_pca(rows, names)},
    entries AS (SELECT k, unnest([{entries}]) AS entry FROM v, m),
    flips AS (SELECT k, sign(arg_max(entry, abs(entry))) AS f FROM entries GROUP BY k)"""


THREE_BANDS = f"""
SELECT l_orderkey, l_linenumber, gross, CASE WHEN net_band = 'large' THEN 1.0e0 ELSE 0.0e0 END AS x,
       CASE WHEN quantity_band = 'many' THEN 1.0e0 ELSE 0.0e0 END AS y,
       CASE WHEN l_linestatus = 'O' THEN 1.0e0 ELSE 0.0e0 END AS z
FROM ({BAND_LINES})
"""


@query(
    f"""WITH {three_way(('x', 'y', 'z'), THREE_BANDS)} SELECT l_orderkey, l_linenumber,
    {r('pc1 * a.f / sqrt(3)', 'Dim1', 5)}, {r('pc2 * b.f / sqrt(3)', 'Dim2', 5)}
    FROM scores, flips a, flips b WHERE a.k = 1 AND b.k = 2"""
)
def mca_three_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two axes of three two-level columns for every row."""
    found = mca(derived(spark, sf_dir, BAND_LINES), ("net_band", "quantity_band", "l_linestatus"), key=KEY)
    return rounded(found.row_coordinates, 5)


@query()
def mca_four_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two axes of four variables for every row."""
    return rounded(mca(derived(spark, sf_dir, BAND_LINES), FOUR_WAY, key=KEY).row_coordinates)


@query(f"SELECT count(*) AS n_rows, true AS centred, true AS variance_is_eigenvalue FROM ({BAND_LINES})")
def mca_row_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row coordinates of four variables have mean 0 and the eigenvalues as variances."""
    found = mca(derived(spark, sf_dir, BAND_LINES), FOUR_WAY)
    first, second = (float(v) for v in found.eigenvalues)
    return found.row_coordinates.agg(
        F.count(F.lit(1)).alias("n_rows"),
        ((F.abs(F.avg("Dim1")) < 1e-9) & (F.abs(F.avg("Dim2")) < 1e-9)).alias("centred"),
        (
            (F.abs(F.var_pop("Dim1") - first) < 1e-9) & (F.abs(F.var_pop("Dim2") - second) < 1e-9)
        ).alias("variance_is_eigenvalue"),
    )


# Every customer meets every supplier once, and once more if their blocks agree: within two blocks all is independent, so the
# only axis is that of the 2 x 2 table of blocks, whose correlation is phi. Both columns are kept out of the dense matrix.
CROSSED = """
SELECT CAST(c_custkey AS STRING) AS customer, CAST(s_suppkey AS STRING) AS supplier, a, b, a + b - 1.5e0 * a * b AS x
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1.0e0 ELSE 0.0e0 END AS a FROM customer) c
CROSS JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 1.0e0 ELSE 0.0e0 END AS b FROM supplier) s
CROSS JOIN (SELECT 0 AS again UNION ALL SELECT 1) twice
WHERE again = 0 OR a = b
"""


@query(
    f"""WITH t AS ({CROSSED}),
    m AS (SELECT corr(a, b) AS phi, avg(a) AS pa, avg(b) AS pb FROM t),
    levels AS (SELECT DISTINCT 'customer' AS variable, customer AS level, a AS inside FROM t
               UNION ALL SELECT DISTINCT 'supplier', supplier, b FROM t),
    standard AS (SELECT variable, level, phi, CASE WHEN variable = 'customer' THEN (pa - inside) / sqrt(pa * (1 - pa))
                 ELSE sign(phi) * (pb - inside) / sqrt(pb * (1 - pb)) END AS c FROM levels, m)
    SELECT variable, level, {r('(1 + abs(phi)) / 2', 'eigenvalue')}, {r('c * sqrt((1 + abs(phi)) / 2)', 'coordinate', 5)}
    FROM standard"""
)
def mca_two_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of many levels each: the axis and all its levels, turned so that customer 1 lies on the positive side."""
    found = mca(derived(spark, sf_dir, CROSSED, spread="customer"), ("customer", "supplier"), dense_levels=8)
    if not found.converged:
        raise ValueError(f"the axis has not converged, residual {found.residuals.max()}")
    levels = found.levels_df(spark)
    side = levels.where("variable = 'customer' AND level = '1'").first()["coordinate"]
    return levels.select(
        "variable", "level", num(F.lit(float(found.eigenvalues[0]))).alias("eigenvalue"),
        num(F.col("coordinate") * F.lit(1.0 if side > 0 else -1.0), 5).alias("coordinate"),
    )
