"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another. The model of a category sees the text's features and the probabilities
of all categories before it. While training, those are out-of-fold predictions: each comes from a model that has not
seen the document, so later models learn how far earlier ones can be trusted.

Categories, in the chain's order: ``low_quality`` (quality is 0), ``toxic``, and ``severe`` (toxic, and at least
``SEVERE_TERMS`` occurrences of strong terms). The models are fitted on about ``sample_rows`` labelled documents, chosen
by a hash of the key. Features are the ``n_terms`` terms that tell toxic documents apart best, all strong ones among
them together (shares ``STRONG`` standard deviations apart and more), and style features. Every document is scored
whole.

NULL texts count as empty. Labels with NULL keys or categories are not used; of repeated labels the lowest quality and
the largest toxicity hold.
Without labels, or with labels of one class, the probabilities are the smoothed shares and no document is toxic by
them unless most labels are. Repeated documents get equal scores; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm import logistic
from tablescope.llm.labels import labelled
from tablescope.llm.shared import as_text, slices
from tablescope.llm.tokens import Words

CATEGORIES = ("low_quality", "toxic", "severe")
SAMPLE_ROWS = 20_000
N_TERMS = 150
FOLDS = 5
SEVERE_TERMS = 4
STRONG = 1.0
THRESHOLD = 0.5


@dataclass
class Chain:
    """Weights of each category; ``terms`` gives each term its place among the features, the strong ones first.

    ``low`` and ``high`` bound the features to what training has seen, so that a very long text is judged as the longest
    known one.
    """

    terms: dict[str, int] = field(default_factory=dict)
    n_strong: int = 0
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    weights: list[np.ndarray] = field(default_factory=list)

    def features(self, texts: pa.Array) -> np.ndarray:
        lowered = logistic.lower(texts)
        words = Words(lowered)
        counts = logistic.counts_of(self.terms, lowered, words, len(self.terms))
        strong = np.log1p(np.expm1(counts[:, : self.n_strong]).sum(axis=1, keepdims=True))
        x = np.concatenate([strong, counts, logistic.style(texts, words)], axis=1)
        return x if self.low is None else np.clip(x, self.low, self.high)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.concatenate([out, logistic.predict(np.concatenate([x, out], axis=1), w)[:, None]], axis=1)
        return out


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights of all categories, and the out-of-fold probabilities they were trained with."""
    weights, earlier = [], np.zeros((len(x), 0))
    for j in range(y.shape[1]):
        seen = np.concatenate([x, earlier], axis=1)
        held = np.zeros(len(x))
        for f in range(FOLDS):
            out = folds == f
            if out.any():
                held[out] = logistic.predict(seen[out], logistic.fit(seen[~out], y[~out, j]))
        weights.append(logistic.fit(seen, y[:, j]))
        earlier = np.concatenate([earlier, held[:, None]], axis=1)
    return weights, earlier


def marking_terms(sample: DataFrame, n_terms: int) -> list[tuple[str, float]]:
    """Terms whose share among toxic documents exceeds that among the others most, in standard deviations."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()
        for batch in batches:
            for t, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = {w.strip(".,;:!?\"'()") for w in t.lower().split()}
                seen.update(found)
                if label:
                    toxic.update(found)
        names = list(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([seen[w] for w in names], pa.int64()),
                pa.array([toxic[w] for w in names], pa.int64()),
            ],
            names=["term", "n", "n_toxic"],
        )

    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, positive = totals.n, totals.toxic or 0.0
    if not positive or positive == n:
        return []
    p = (F.col("n") + 1) / F.lit(n + 2.0)
    excess = F.col("n_toxic") / F.lit(positive) - (F.col("n") - F.col("n_toxic")) / F.lit(n - positive)
    scored = (
        sample.mapInArrow(count, "term string, n bigint, n_toxic bigint")
        .where("term <> ''")
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
        .where("n >= 3")
        .select("term", (excess / F.sqrt(p * (1 - p) + F.lit(1e-4))).alias("z"))
    )
    return [(r.term, r.z) for r in scored.orderBy(F.desc("z"), "term").limit(n_terms).collect()]


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    sample_rows: int = SAMPLE_ROWS, n_terms: int = N_TERMS,
) -> Chain:
    wanted = {"low": 1 - F.min("quality"), "toxic": F.max("toxic")}
    sample = labelled(docs, labels, key, text, wanted, sample_rows)
    found = marking_terms(sample, n_terms)
    chain = Chain({t: i for i, (t, _) in enumerate(found)}, sum(z >= STRONG for _, z in found))
    width = 1 + len(chain.terms) + len(logistic.STYLE)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = chain.features(batch.column("text")).astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "low", "toxic")), pa.array([r.tobytes() for r in x], pa.binary())],
                names=["id", "low", "toxic", "x"],
            )

    kind = sample.schema["id"].dataType.simpleString()
    shape = sample.mapInArrow(rows, f"id {kind}, low double, toxic double, x binary")
    shape = shape.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)))
    got = shape.orderBy("id").collect()
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), dtype="<f4").reshape(len(got), width).astype(float)
    if len(x):
        chain.low, chain.high = x.min(axis=0), x.max(axis=0)
    toxic = np.array([r.toxic for r in got])
    severe = toxic * (np.expm1(x[:, 0]) > SEVERE_TERMS - 0.5)
    y = np.stack([np.array([r.low for r in got]), toxic, severe], axis=1)
    chain.weights, _ = fit_chain(x, y.reshape(len(got), len(CATEGORIES)), np.array([r.fold for r in got]))
    return chain


def score(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, p_low_quality, p_toxic, p_severe, toxic), one for each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            p = chain.probabilities(chain.features(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array(c) for c in p.T)], names=["doc_id", *(f"p_{c}" for c in CATEGORIES)]
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"p_{c} double" for c in CATEGORIES)
    found = docs.select(F.col(key).alias("key"), as_text(text).alias("text")).mapInArrow(run, schema)
    return found.withColumn("toxic", F.col("p_toxic") >= threshold)


def without_toxic(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the chain doesn't call toxic, with all their columns."""
    order = CATEGORIES.index("toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(text).cast(pa.string()).fill_null("")
            p = chain.probabilities(chain.features(texts))[:, order]
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
