"""Sanitization, column kinds and descriptive statistics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope import TableAnalysis, column_profile, detect, routing_df, sanitize
from tablescope.functions.columns import cell, measure, numeric_columns
from tablescope.functions.tables import small_table
from tablescope.operators.sanitize import minimum_requirements, requirements_df
from tablescope.operators.statistics import column_statistics
from tablescope.plans.cleaner import TableCleaner
from tablescope.plans.reuse import new_folder
from workloads.registry import GAPPY_LINES, PRICE_LINES, derived, load, num, query, r, rounded


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return orders.select(*numeric_columns(orders))


CONSTANTS = """
SELECT l_quantity, CASE WHEN l_quantity > 0 THEN 42 END AS always_42, nullif(l_linenumber, l_linenumber) AS all_null,
       CASE WHEN l_tax > 0 THEN 7 END AS seven_or_null, l_linenumber
FROM lineitem
"""
CONSTANT_NAMES = ("l_quantity", "always_42", "all_null", "seven_or_null", "l_linenumber")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1 AS dropped
        FROM ({CONSTANTS})"""
        for c in CONSTANT_NAMES
    )
)
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing cell counts as a value of its own, so {7, missing} is not constant."""
    table = derived(spark, sf_dir, CONSTANTS)
    dropped = sanitize(table, min_unique_ratio=0.0).dropped_constant_cols
    return small_table(spark, [(c, c in dropped) for c in CONSTANT_NAMES], "variable string, dropped boolean")


@query(
    f"""SELECT count(*) AS n_rows, count(*) * 4 - count(price) - count(tax) - count(discount) - count(quantity) AS n_missing
    FROM ({GAPPY_LINES})"""
)
def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = derived(spark, sf_dir, GAPPY_LINES)
    n, found = column_statistics(table, {c: measure(table, c) for c in ("price", "tax", "discount", "quantity")})
    return small_table(spark, [(n, sum(s.n_missing for s in found.values()))], "n_rows bigint, n_missing bigint")


def _fill_query(price: str, tax: str, discount: str) -> str:
    return f"""
    WITH g AS ({GAPPY_LINES}), f AS (SELECT ({price}) AS price_fill, ({tax}) AS tax_fill, ({discount}) AS discount_fill)
    SELECT l_orderkey, l_linenumber, l_partkey, {r('coalesce(price, price_fill)', 'price')},
           {r('coalesce(tax, tax_fill)', 'tax')}, {r('coalesce(discount, discount_fill)', 'discount')}
    FROM g, f
    """


def _mode(c: str) -> str:
    return f"SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1"


def _filled(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    table = derived(spark, sf_dir, GAPPY_LINES)
    key = ("l_orderkey", "l_linenumber", "l_partkey")
    plan = sanitize(table, min_unique_ratio=0.0, imputation_strategy=strategy, key=key, exclude=("quantity",)).plan
    return table.select(*key, *[num(plan.cell(table, p)).alias(p.name) for p in plan.columns])


@query(_fill_query(*[f"SELECT median({c}) FROM g" for c in ("price", "tax", "discount")]))
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, "median")


@query(_fill_query(*[f"SELECT avg({c}) FROM g" for c in ("price", "tax", "discount")]))
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, "mean")


@query(_fill_query(*[_mode(c) for c in ("price", "tax", "discount")]))
def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value, the smallest on ties."""
    return _filled(spark, sf_dir, "most_frequent")


LINE_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE) < 0.01 AS dropped FROM lineitem"
        for c in LINE_NUMBERS
    )
)
def low_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = sanitize(load(spark, sf_dir, "lineitem")).dropped_low_variance_cols
    return small_table(spark, [(c, c in dropped) for c in LINE_NUMBERS], "variable string, dropped boolean")


@query(
    f"""WITH t AS ({PRICE_LINES}), m AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}"
        for c in ("quantity", "price", "net", "charge"))} FROM t)
    SELECT l_orderkey, l_linenumber, {", ".join(r(f"({c} - m_{c}) / s_{c}", c) for c in ("quantity", "price", "net", "charge"))}
    FROM t, m"""
)
def zscore_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ("l_orderkey", "l_linenumber")
    table = derived(spark, sf_dir, PRICE_LINES)
    plan = sanitize(table, min_unique_ratio=0.0, key=key).plan
    return rounded(plan.zscores(table, key))


@query(
    f"""WITH t AS ({PRICE_LINES}), m AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}"
        for c in ("quantity", "price", "net", "charge"))} FROM t)
    SELECT l_orderkey, l_linenumber, quantity, price, net, charge FROM t, m WHERE {" AND ".join(f"abs(({c} - m_{c}) / s_{c}) < 2.0" for c in ("quantity", "price", "net", "charge"))}"""
)
def outlier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row goes when any z-score reaches the threshold."""
    key = ("l_orderkey", "l_linenumber")
    cleaned = sanitize(derived(spark, sf_dir, PRICE_LINES), zscore_threshold=2.0, min_unique_ratio=0.0, key=key)
    return cleaned.df


# The whole chain on the gappy lines at the default 1 % rule: median fill, near-constant columns out, outliers out.
_CLEAN_CHAIN = f"""
WITH g AS ({GAPPY_LINES}),
f AS (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(price, (SELECT median(price) FROM g)) AS price FROM g),
m AS (SELECT avg(l_partkey) AS m_part, stddev_pop(l_partkey) AS s_part, avg(l_orderkey) AS m_order,
      stddev_pop(l_orderkey) AS s_order, avg(price) AS m_price, stddev_pop(price) AS s_price FROM f),
kept AS (SELECT l_orderkey, l_partkey, price FROM f, m WHERE abs((l_orderkey - m_order) / s_order) < 2.0
      AND abs((l_partkey - m_part) / s_part) < 2.0 AND abs((price - m_price) / s_price) < 2.0)
"""


@query(f"{_CLEAN_CHAIN} SELECT l_orderkey, l_partkey, price FROM kept")
def sanitize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps at the default 1 % rule with threshold 2; identifiers are numbers like any other."""
    return sanitize(derived(spark, sf_dir, GAPPY_LINES), zscore_threshold=2.0).df


_REPORT = f"""{_CLEAN_CHAIN},
sizes AS (SELECT (SELECT count(*) FROM g) AS n_in, (SELECT count(*) FROM kept) AS n_out,
      (SELECT count(*) * 3 - count(price) - count(tax) - count(discount) FROM g) AS n_missing)
"""


@query(
    f"""{_REPORT}
    SELECT n_in AS n_rows_input, CAST(7 AS BIGINT) AS n_cols_input, '' AS dropped_constant,
           'l_linenumber,quantity,tax,discount' AS dropped_low_variance, n_missing AS imputed_values,
           n_in - n_out AS outliers_removed, n_out AS n_rows_output, CAST(3 AS BIGINT) AS n_cols_output,
           {r('n_out * 100.0 / n_in', 'pct_rows_retained', 4)}, {r('n_missing * 100.0 / (n_in * 7)', 'pct_missing', 4)},
           n_out * 100.0 / n_in < 70 AS low_retention
    FROM sizes"""
)
def sanitize_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = sanitize(derived(spark, sf_dir, GAPPY_LINES), zscore_threshold=2.0).report.to_df(spark)
    return report.select(
        "n_rows_input",
        "n_cols_input",
        F.array_join("dropped_constant_cols", ",").alias("dropped_constant"),
        F.array_join("dropped_low_variance_cols", ",").alias("dropped_low_variance"),
        "imputed_values",
        "outliers_removed",
        "n_rows_output",
        "n_cols_output",
        num("pct_rows_retained", 4).alias("pct_rows_retained"),
        num("pct_missing", 4).alias("pct_missing"),
        "low_retention",
    )


_DISPLAY = (
    ("Lignes (entrée)", "CAST(n_in AS VARCHAR)"),
    ("Colonnes (entrée)", "'7'"),
    ("Colonnes constantes supprimées", "'0'"),
    ("Colonnes quasi-constantes supprimées", "'4'"),
    ("Valeurs imputées", "CAST(n_missing AS VARCHAR)"),
    ("Outliers supprimés", "CAST(n_in - n_out AS VARCHAR)"),
    ("Lignes (sortie)", "CAST(n_out AS VARCHAR)"),
    ("Colonnes (sortie)", "'3'"),
    ("% lignes conservées", "printf('%.1f%%', n_out * 100.0 / n_in)"),
    ("% valeurs manquantes", "printf('%.2f%%', n_missing * 100.0 / (n_in * 7))"),
)


@query(_REPORT + " UNION ALL ".join(f"SELECT '{k}' AS metric, {v} AS value FROM sizes" for k, v in _DISPLAY))
def sanitize_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize(derived(spark, sf_dir, GAPPY_LINES), zscore_threshold=2.0).report.display_df(spark)


@query(
    " UNION ALL ".join(
        f"""SELECT '{t}' AS name, 'rows' AS "check", count(*) AS actual, CAST(10 AS BIGINT) AS required, count(*) >= 10 AS ok FROM {t}
        UNION ALL SELECT '{t}', 'columns', CAST({w} AS BIGINT), CAST(2 AS BIGINT), {w} >= 2"""
        for t, w in (("region", 1), ("nation", 2), ("supplier", 3), ("events", 3))
    )
)
def minimum_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least 10 rows and 2 numeric columns."""
    found = None
    for name in ("region", "nation", "supplier", "events"):
        table = load(spark, sf_dir, name)
        checks = minimum_requirements(table.count(), len(numeric_columns(table)))
        part = requirements_df(spark, checks).select(F.lit(name).alias("name"), "*")
        found = part if found is None else found.unionAll(part)
    return found


def _profile_sql(table: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS name, '{c}' AS variable, count(*) AS n_rows, count(*) - count({c}) AS n_missing,
        count(DISTINCT {c}) AS n_distinct, {r(f'count(DISTINCT {c}) / CAST(count(*) AS DOUBLE)', 'distinct_ratio')},
        (SELECT CAST({c} AS DOUBLE) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode
        FROM {table}"""
        for c in columns
    )


PROFILED = {
    "lineitem": LINE_NUMBERS,
    "part": ("p_partkey", "p_size", "p_retailprice"),
    "labels": ("doc_id", "quality", "toxic"),
    "events": ("event_id", "user_id", "value"),
}


@query(" UNION ALL ".join(_profile_sql(t, c) for t, c in PROFILED.items()))
def column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, missing cells, exact distinct values, ratio and mode."""
    found = None
    for name in PROFILED:
        part = column_profile(load(spark, sf_dir, name)).select(F.lit(name).alias("name"), "*")
        found = part if found is None else found.unionAll(part)
    return rounded(found)


DETECTED = {
    "lineitem": (LINE_NUMBERS, ("l_returnflag", "l_linestatus", "l_shipdate")),
    "orders": (("o_orderkey", "o_custkey", "o_totalprice"), ("o_orderstatus", "o_orderdate", "o_orderpriority")),
    "part": (("p_partkey", "p_size", "p_retailprice"), ("p_name", "p_brand", "p_type")),
    "labels": (("doc_id", "quality", "toxic"), ()),
    "region": (("r_regionkey",), ("r_name",)),
}


def _kind_sql(table: str, numbers: tuple[str, ...], others: tuple[str, ...]) -> str:
    parts = [
        f"""SELECT '{table}' AS name, '{c}' AS variable,
        CASE WHEN count(DISTINCT {c}) <= 1 THEN 'ignored' WHEN count(DISTINCT {c}) = 2 THEN 'binary'
             WHEN count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) < 0.05 THEN 'categorical'
             WHEN count(DISTINCT {c}) < 10 THEN 'ignored' ELSE 'continuous' END AS kind FROM {table}"""
        for c in numbers
    ]
    parts += [f"SELECT '{table}', '{c}', 'ignored'" for c in others]
    return " UNION ALL ".join(parts)


KINDS_SQL = " UNION ALL ".join(_kind_sql(t, *c) for t, c in DETECTED.items())


@query(KINDS_SQL)
def detect_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for name in DETECTED:
        part = detect(load(spark, sf_dir, name)).to_df(spark).select(F.lit(name).alias("name"), "*")
        found = part if found is None else found.unionAll(part)
    return found


@query(
    f"""SELECT name, kind, count(*) AS n_variables, string_agg(variable, ',' ORDER BY variable) AS variables
    FROM ({KINDS_SQL}) GROUP BY name, kind"""
)
def detect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for name in DETECTED:
        part = detect(load(spark, sf_dir, name)).summary_df(spark).select(F.lit(name).alias("name"), "*")
        found = part if found is None else found.unionAll(part)
    return found.withColumn("variables", F.array_join("variables", ","))


@query(
    f"""WITH k AS (SELECT name, count(*) FILTER (WHERE kind = 'continuous') AS n_cont,
               count(*) FILTER (WHERE kind IN ('categorical', 'binary')) AS n_cat FROM ({KINDS_SQL}) GROUP BY name)
    , a AS (SELECT name, n_cont, n_cat, 'pca' AS method, n_cont >= 2 AS applicable FROM k
    UNION ALL SELECT name, n_cont, n_cat, 'factor_analysis', n_cont >= 2 FROM k
    UNION ALL SELECT name, n_cont, n_cat, 'mca', n_cat >= 2 FROM k
    UNION ALL SELECT name, n_cont, n_cat, 'famd', n_cont >= 1 AND n_cat >= 1 FROM k)
    SELECT name, method, applicable, CASE WHEN n_cont + n_cat = 0 THEN 'no usable variable'
        WHEN method = 'famd' THEN CASE WHEN applicable THEN 'continuous and categorical variables' ELSE 'not a mixed table' END
        ELSE (CASE least(2, CASE WHEN method = 'mca' THEN n_cat ELSE n_cont END) WHEN 2 THEN 'two or more ' WHEN 1 THEN 'a single ' ELSE 'no ' END)
          || (CASE WHEN method = 'mca' THEN 'categorical' ELSE 'continuous' END)
          || (CASE least(2, CASE WHEN method = 'mca' THEN n_cat ELSE n_cont END) WHEN 2 THEN ' variables' WHEN 1 THEN ' variable, two are needed' ELSE ' variable' END)
        END AS reason FROM a"""
)
def method_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for name in DETECTED:
        part = routing_df(spark, detect(load(spark, sf_dir, name))).select(F.lit(name).alias("name"), "*")
        found = part if found is None else found.unionAll(part)
    return found


def describe_sql(table: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count(*) AS count, {r('avg(x)', 'mean', 6)}, {r('stddev_samp(x)', 'std', 4)},
        {r('min(x)', 'min', 4)}, {r('quantile_cont(x, 0.25)', 'q25', 4)}, {r('quantile_cont(x, 0.5)', 'q50', 4)},
        {r('quantile_cont(x, 0.75)', 'q75', 4)}, {r('max(x)', 'max', 4)}, {r('skewness(x)', 'skewness', 4)},
        {r('kurtosis(x)', 'kurtosis', 4)}, {r('avg(CASE WHEN gap THEN 1.0 ELSE 0.0 END) * 100', 'missing_pct', 2)}
        FROM (SELECT coalesce(CAST({c} AS DOUBLE), 0.0) AS x, {c} IS NULL AS gap FROM ({table}))"""
        for c in columns
    )


_GAPPY_NAMES = ("quantity", "price", "tax", "discount")


@query(describe_sql(GAPPY_LINES, _GAPPY_NAMES))
def describe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(TableAnalysis(derived(spark, sf_dir, GAPPY_LINES), _GAPPY_NAMES).describe(), 4, mean=6)


@query(describe_sql("SELECT * FROM events", ("event_id", "user_id", "value")))
def describe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(TableAnalysis(load(spark, sf_dir, "events")).describe(), 4, mean=6)


LABELLED = "SELECT d.doc_id, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query(describe_sql(LABELLED, ("n_chars", "quality", "toxic")))
def describe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label have genuinely missing cells."""
    return rounded(TableAnalysis(derived(spark, sf_dir, LABELLED), key=["doc_id"]).describe(), 4, mean=6)


_INFINITE = """
SELECT l_orderkey, l_linenumber, l_quantity,
       CASE WHEN l_tax = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_tax = 0.01 THEN CAST('-Infinity' AS DOUBLE)
            WHEN l_tax = 0.02 THEN CAST('NaN' AS DOUBLE) WHEN l_tax = 0.03 THEN NULL ELSE l_extendedprice END AS price
FROM lineitem
"""


@query(
    f"""SELECT l_orderkey, l_linenumber, l_quantity,
    CASE WHEN price IS NULL OR isnan(price) OR isinf(price) THEN 0.0 ELSE price END AS price FROM ({_INFINITE})"""
)
def prepare_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, NaN and infinite cells count as 0 in the analyses."""
    analysis = TableAnalysis(derived(spark, sf_dir, _INFINITE), ("l_quantity", "price"))
    return analysis.df.select("l_orderkey", "l_linenumber", *[v.alias(c) for c, v in analysis.values.items()])


@query(
    f"""SELECT l_orderkey, l_linenumber, l_quantity,
    CASE WHEN price IS NOT NULL AND NOT isnan(price) AND NOT isinf(price) THEN price END AS price FROM ({_INFINITE})"""
)
def missing_as_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One notion of a missing cell for NULL, NaN and infinities."""
    table = derived(spark, sf_dir, _INFINITE)
    return table.select("l_orderkey", "l_linenumber", "l_quantity", cell(table, "price").alias("price"))


@query(
    f"""WITH m AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2
    FROM part) SELECT p_partkey, {r('(p_size - m1) / s1', 'p_size')}, {r('(p_retailprice - m2) / s2', 'p_retailprice')},
    0.0 AS one FROM part, m"""
)
def standardize_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population deviation; a constant column gives zeros."""
    table = load(spark, sf_dir, "part").withColumn("one", F.lit(1))
    analysis = TableAnalysis(table, ("p_size", "p_retailprice", "one"), key=["p_partkey"])
    return rounded(analysis.standardized())


PLAIN_LINES = "SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_extendedprice AS price FROM lineitem"


@query(
    f"""
    WITH f AS (SELECT avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(price) AS mp, stddev_pop(price) AS sp FROM ({PLAIN_LINES})),
    g AS (SELECT l_orderkey, l_linenumber, quantity, coalesce(price, mp) AS price, mq, sq, mp, sp FROM ({GAPPY_LINES}), f)
    SELECT l_orderkey, l_linenumber, {r('quantity', 'quantity')}, {r('price', 'price')} FROM g
    WHERE abs((quantity - mq) / sq) < 1.5 AND abs((price - mp) / sp) < 1.5
    """
)
def plan_for_another_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted where no price is missing, applied where a third of them are."""
    key = ("l_orderkey", "l_linenumber")
    fitted = sanitize(
        derived(spark, sf_dir, PLAIN_LINES), 1.5, 0.0, "mean", exclude=key, fill_all=True
    )
    return rounded(fitted.plan.apply(derived(spark, sf_dir, GAPPY_LINES), key))


HALVES = f"SELECT * FROM ({GAPPY_LINES}) WHERE l_orderkey % 2 = "


@query(
    f"""
    WITH f AS (SELECT median(quantity) AS fq, median(price) AS fp FROM ({HALVES}0)),
    h AS (SELECT coalesce(quantity, fq) AS quantity, coalesce(price, fp) AS price FROM ({HALVES}0), f),
    m AS (SELECT avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(price) AS mp, stddev_pop(price) AS sp FROM h),
    g AS (SELECT l_orderkey, l_linenumber, coalesce(quantity, fq) AS quantity, coalesce(price, fp) AS price
          FROM ({HALVES}1), f)
    SELECT l_orderkey, l_linenumber, {r('quantity', 'quantity')}, {r('price', 'price')} FROM g, m
    WHERE abs((quantity - mq) / sq) < 1.5 AND abs((price - mp) / sp) < 1.5
    """
)
def saved_cleaner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline fitted on the even orders, saved, loaded and applied to the odd ones."""
    key = ["l_orderkey", "l_linenumber"]
    even, odd = (derived(spark, sf_dir, f"{HALVES}{i}").select(*key, "quantity", "price") for i in (0, 1))
    cleaner = TableCleaner(zscoreThreshold=1.5, minUniqueRatio=0.0, keyCols=key)
    location = new_folder(spark, "cleaner")
    Pipeline(stages=[cleaner]).fit(even).write().save(location)
    return rounded(PipelineModel.load(location).transform(odd))


LARGE_KEYS = """
SELECT l_quantity, 9007199254740992 + l_linenumber % 2 AS pair, 9007199254740993 + 0 * l_linenumber AS same,
       9007199254740992 + l_orderkey AS large_key
FROM lineitem
"""


@query(
    f"""SELECT pair, count(*) AS n_rows, min(large_key) AS first_key, max(large_key) AS last_key FROM ({LARGE_KEYS})
    GROUP BY pair"""
)
def large_whole_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers that doubles cannot tell apart: only the column with one value goes."""
    found = sanitize(derived(spark, sf_dir, LARGE_KEYS), 6.0, 0.0)
    if found.dropped_constant_cols != ["same"] or found.dropped_low_variance_cols:
        raise ValueError(f"dropped {found.dropped_constant_cols} and {found.dropped_low_variance_cols}")
    return found.df.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("large_key").alias("first_key"), F.max("large_key").alias("last_key")
    )
