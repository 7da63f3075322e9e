"""Document quality: the classifier's evidence combined with what the document's site tells.

The text gives p, the probability of good quality under a linear classifier. Sites form a hierarchy: all documents, the
host, the path below the host. A host's mean is shrunk toward the global mean, a path's mean toward its host's, by
empirical Bayes: the strength kappa of each prior follows from the variance between sites beyond what chance explains,
so sites that differ little, or have few documents, follow their parent. The document itself is left out of its site's
sums. In log odds:

    posterior = logit(p) + logit(path's mean without the document) - logit(global mean)

Only grouped sums over hosts and paths are joined to the documents; of a group of any size one row remains, and groups
combine inside the tasks before they are shuffled. The classifier is fitted on about ``sample_rows`` labelled
documents, chosen by a hash of the key, over style features.

NULL texts count as empty; a NULL host or path is a site of its own. Labels with NULL keys or values are not used, of
repeated labels the smallest quality holds. Repeated documents count each. Without labels p is one third everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm import logistic
from tablescope.llm.labels import labelled
from tablescope.llm.shared import as_text, slices, written

SAMPLE_ROWS = 20_000
THRESHOLD = 0.5
WEAKEST, STRONGEST = 1.0, 1e6


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> np.ndarray:
    """Weights of the style features for good quality."""
    sample = labelled(docs, labels, key, text, {"good": F.min("quality")}, sample_rows)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = logistic.style(batch.column("text")).astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("good"), pa.array([r.tobytes() for r in x], pa.binary())],
                names=["id", "good", "x"],
            )

    kind = sample.schema["id"].dataType.simpleString()
    got = sample.mapInArrow(rows, f"id {kind}, good double, x binary").orderBy("id").collect()
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), dtype="<f4").reshape(len(got), len(logistic.STYLE))
    return logistic.fit(wide(x.astype(float)), np.array([r.good for r in got], dtype=float))


def wide(x: np.ndarray) -> np.ndarray:
    """Features and their squares: too few and too many marks both tell."""
    return np.concatenate([x, x * x], axis=1)


def evidence(
    docs: DataFrame, weights: np.ndarray, host: Column, path: Column, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (doc_id, host, path, p)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            p = np.clip(logistic.predict(wide(logistic.style(batch.column("text"))), weights), 1e-6, 1 - 1e-6)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "host", "path")), pa.array(p)],
                names=["doc_id", "host", "path", "p"],
            )

    rows = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"), as_text(text).alias("text"),
    )
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, host string, path string, p double")


def strength(spread: float, within: float, groups: float, weight: float, mean: float) -> float:
    """Prior strength from the groups' weighted spread around their parents, beyond ``within``; see ``site_means``."""
    if weight <= 0:
        return STRONGEST
    variance = (spread - groups * within) / weight
    top = mean * (1 - mean)
    return float(np.clip(top / variance - 1 if variance > 0 else STRONGEST, WEAKEST, STRONGEST)) if top else STRONGEST


def site_means(rows: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Sums of each (host, path) with its host's, and the global mean with both prior strengths.

    Between-group variance by moments: with pooled variance w inside the groups, the weighted spread of group means
    around their parent's mean is w * (groups - parents) + tau**2 * (N - sum of n**2 / n of the parent).
    """
    paths = written(
        rows.groupBy("host", "path").agg(F.count("p").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") ** 2).alias("q")),
        "paths",
    )
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("q").alias("host_q"),
        F.sum(F.col("n") * F.col("n")).alias("host_nn"), F.sum(F.col("s") ** 2 / F.col("n")).alias("host_means"),
        F.count("*").alias("host_paths"),
    )
    hosts = written(hosts, "hosts")
    t = hosts.agg(
        F.sum("host_n").alias("n"), F.sum("host_s").alias("s"), F.sum("host_q").alias("q"),
        F.sum(F.col("host_n") ** 2).alias("nn"), F.sum(F.col("host_s") ** 2 / F.col("host_n")).alias("host_means"),
        F.sum("host_means").alias("path_means"), F.sum(F.col("host_nn") / F.col("host_n")).alias("path_nn"),
        F.sum("host_paths").alias("paths"), F.count("*").alias("hosts"),
    ).first()
    if not t.n:
        return paths.join(hosts, "host"), {"mean": 0.5, "host": STRONGEST, "path": STRONGEST}
    mean = t.s / t.n
    within = max(0.0, t.q - t.path_means) / max(1, t.n - t.paths)
    return paths.join(hosts, "host"), {
        "mean": mean,
        "host": strength(t.host_means - t.s**2 / t.n, within, t.hosts - 1, t.n - t.nn / t.n, mean),
        "path": strength(t.path_means - t.host_means, within, t.paths - t.hosts, t.n - t.path_nn, mean),
    }


def posterior(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Rows (doc_id, p_text, site_mean, p_good, kept), one for each document."""
    weights = train(docs, labels, key, text, sample_rows)
    rows = written(evidence(docs, weights, host, path, key, text), "evidence")
    sites, prior = site_means(rows)
    p, m = F.col("p"), F.lit(prior["mean"])
    host_mean = (F.lit(prior["host"]) * m + F.col("host_s") - p) / (F.lit(prior["host"]) + F.col("host_n") - 1)
    path_mean = (F.lit(prior["path"]) * host_mean + F.col("s") - p) / (F.lit(prior["path"]) + F.col("n") - 1)
    site = F.least(F.greatest(path_mean, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda x: F.log(x / (1 - x))
    return (
        rows.join(sites.select("host", "path", "n", "s", "host_n", "host_s"), ["host", "path"])
        .withColumn("site_mean", site)
        .withColumn("odds", logit(p) + logit(F.col("site_mean")) - logit(m))
        .select(
            "doc_id", p.alias("p_text"), "site_mean", (1 / (1 + F.exp(-F.col("odds")))).alias("p_good"),
            (F.col("odds") >= F.lit(float(np.log(threshold / (1 - threshold))))).alias("kept"),
        )
    )
