"""Sources, sinks, shape and preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.tables import small_table
from tablescope.plans.reuse import new_folder
from tablescope.sources.catalog import default_query, list_tables, preview, run_query, shape, write_table
from tablescope.sources.csv_files import location_label, read_csv, write_csv
from workloads.registry import GAPPY_LINES, TABLES, derived, load, query


LINES = """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag,
       CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)) AS shipdate
FROM lineitem
"""


@query(LINES)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with semicolons, read back with separator and types detected."""
    folder = new_folder(spark) + "/lines"
    write_csv(derived(spark, sf_dir, LINES), folder, separator=";")
    back = read_csv(spark, folder)
    return back.withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query(
    "SELECT doc_id, md5(text) AS text_hash, CAST(length(text) AS INTEGER) AS n_read, lang, source FROM documents"
)
def csv_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text with quotes, separators and line breaks inside quoted cells."""
    folder = new_folder(spark) + "/texts"
    write_csv(load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), folder)
    back = read_csv(
        spark, folder, separator=",", multiline=True, schema="doc_id bigint, lang string, source string, text string"
    )
    return back.select("doc_id", F.md5("text").alias("text_hash"), F.length("text").alias("n_read"), "lang", "source")


@query("SELECT 'customers.csv' AS label, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_from_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read from a location string; the label is its last segment."""
    location = new_folder(spark) + "/customers.csv"
    write_csv(load(spark, sf_dir, "customer"), location, separator="\t")
    back = read_csv(spark, location)
    return back.select(
        F.lit(location_label(location)).alias("label"),
        "c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment",
    )


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice in replace mode: the second write is what remains."""
    folder = new_folder(spark) + "/events"
    events = load(spark, sf_dir, "events")
    write_table(events.select("event_id"), folder)
    write_table(events, folder)
    return spark.read.parquet(folder)


SEGMENT_REVENUE = """
SELECT c_mktsegment, o_orderpriority, count(*) AS n_lines,
       round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_returnflag <> 'R'
GROUP BY c_mktsegment, o_orderpriority
"""


@query(SEGMENT_REVENUE)
def sql_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's query over registered tables, result taken as the table to analyse."""
    return derived(spark, sf_dir, SEGMENT_REVENUE)


@query("SELECT * FROM benchmark LIMIT 1000")
def sql_default_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query proposed for the first table by name, which stays below its limit here."""
    for name in TABLES:
        load(spark, sf_dir, name)
    known = [t for t in list_tables(spark) if t in TABLES]
    return run_query(spark, default_query(known))


WIDTHS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(*) AS n_rows, CAST({w} AS INTEGER) AS n_cols FROM {t}" for t, w in WIDTHS.items()
    )
)
def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered tables with their rows and columns."""
    for name in TABLES:
        load(spark, sf_dir, name)
    rows = [(t, *shape(spark.table(t))) for t in list_tables(spark) if t in TABLES]
    return small_table(spark, rows, "name string, n_rows bigint, n_cols int")


@query(
    f"""
    SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
           coalesce(CAST(price AS VARCHAR), '—') AS price, coalesce(CAST(tax AS VARCHAR), '—') AS tax
    FROM (SELECT * FROM ({GAPPY_LINES}) ORDER BY l_orderkey, l_linenumber, l_partkey, quantity LIMIT 50)
    """
)
def preview_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 50 rows, missing cells shown as a dash."""
    lines = derived(spark, sf_dir, GAPPY_LINES).orderBy("l_orderkey", "l_linenumber", "l_partkey", "quantity")
    return preview(lines.select("l_orderkey", "l_linenumber", "price", "tax"))
