"""Registered queries of this subpackage; each applies its operator with production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import (
    capture_index,
    causal_lm,
    crf_pii,
    divergence_audit,
    divergence_rules,
    hamming_trees,
    level_packing,
    periodic_runs,
    pigeonhole,
    separator_scan,
    site_quality,
    suffix_dedup,
    toxicity_chain,
)
from tablescope.llm.shared import import_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is a document's host, its language the path below."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return site_quality.posterior(docs, labels, F.col("source"), F.col("lang"))


@query
def op2_causal_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return causal_lm.score_texts(table(spark, sf_dir, "documents"))


@query
def op3_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pigeonhole.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hamming_trees.document_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hamming_trees.hex_digits("fp").alias("fingerprint"), "component_id")


@query
def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_chain.score(docs, toxicity_chain.train(docs, table(spark, sf_dir, "labels")))


@query
def op6_level_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules.judge(table(spark, sf_dir, "documents"))


@query
def op8_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index.archive_and_read_back(table(spark, sf_dir, "pages"))


@query
def op9_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_pii.find_personal_data(table(spark, sf_dir, "documents"))


@query
def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.count_tokens(table(spark, sf_dir, "documents"))


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.strip_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["size"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.divergences(table(spark, sf_dir, "documents"))


ORACLES["op12_divergence_audit"] = divergence_audit.ORACLE


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of documents of which a tenth repeat themselves; digests of the runs and of the words left."""
    found = periodic_runs.find_runs(periodic_runs.with_repeats(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    best = F.array_min(F.transform("runs", lambda r: F.struct(-r.length, r.start, r.period, r.length.alias("size"))))
    digests = found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(F.transform(lines, lambda t: F.concat(t, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return digests.select(
        "doc_id", "n_runs", "best.start", F.col("best.size").alias("length"), "best.period",
        F.expr("1000 * best.size DIV best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
