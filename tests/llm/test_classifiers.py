"""Site quality and the toxicity chain."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablescope.llm import logistic, site_quality, toxicity_chain

PROSE = ["the river runs", "a quiet town", "they walked home", "rain fell", "the old bridge", "in the morning"]
ABUSE = ["idiot", "moron", "scum"]


def prose(rng, n=12):
    return ". ".join(rng.choice(PROSE) for _ in range(n)).capitalize() + "."


def junk(rng, n=12):
    return " ".join(rng.choice(PROSE).upper() + "!!!" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(240):
        bad, abusive = i % 4 == 0, i % 6 == 1
        text = junk(rng) if bad else prose(rng)
        if abusive:
            text = text.replace(". ", f" you {rng.choice(ABUSE)}. ", 3)
        docs.append((i, text, "host0" if i % 3 == 0 else f"host{i % 7}", "en", "clash"))
        labels.append((i, int(not bad), int(abusive), "clash"))
    docs += [(900, None, None, None, "x"), (901, "", "host0", "en", "x"), (None, prose(rng), "new", "en", "x")]
    docs.append((5, docs[5][1], "host5", "en", "x"))
    labels += [(None, 1, 1, "x"), (901, None, 0, "x"), (5, 1, 0, "x")]
    schema = "doc_id long, text string, source string, lang string, host string"
    return (
        spark.createDataFrame(docs, schema).repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"),
    )


def test_style_of_nothing_and_of_long_texts():
    x = logistic.style(pa.array(["", "a a a B!", "#" * 100_000]))
    assert x.shape == (3, len(logistic.STYLE)) and np.isfinite(x).all() and not x[0].any()
    assert x[1][logistic.STYLE.index("repeats")] > 0 and x[2][logistic.STYLE.index("symbol")] > 4


def test_class_counts_of_a_slice():
    texts = pa.array(["AB", "c1|", "", "D!É"]).slice(1)
    found = logistic.class_counts(texts)
    assert found["n"].tolist() == [3, 0, 4]
    assert found["upper"].tolist() == [0, 0, 1] and found["digit"].tolist() == [1, 0, 0]


def test_logistic_with_one_class_or_no_row():
    assert logistic.predict(np.zeros((1, 2)), logistic.fit(np.zeros((0, 2)), np.zeros(0)))[0] < 0.5
    assert logistic.predict(np.ones((1, 2)), logistic.fit(np.ones((9, 2)), np.zeros(9)))[0] < 0.1


def test_logistic_separates():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 2))
    y = (x[:, 0] > 0.3).astype(float)
    assert ((logistic.predict(x, logistic.fit(x, y)) > 0.5) == y).mean() > 0.97


def test_quality(corpus):
    docs, labels = corpus
    found = site_quality.posterior(docs, labels, F.col("source"), F.col("lang"))
    rows = found.collect()
    assert len(rows) == docs.count()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in rows if r.doc_id is not None and r.doc_id < 240)
    assert all(0 < r.p_good < 1 and 0 < r.site_mean < 1 for r in rows)


def test_site_means_by_hand(spark):
    """Hosts that differ widely get a weak prior, equal hosts a strong one; the sums leave the document out."""
    rows = [(i, "good", "p", 0.99) for i in range(50)] + [(i, "bad", "p", 0.01) for i in range(50, 100)]
    table = spark.createDataFrame([*rows, (200, "rare", "p", 0.5)], "doc_id long, host string, path string, p double")
    sites, prior = site_quality.site_means(table)
    assert prior["mean"] == pytest.approx(0.5, abs=0.01) and prior["host"] < 3
    assert {r.host: r.n for r in sites.collect()} == {"good": 50, "bad": 50, "rare": 1}
    equal = spark.createDataFrame([(i, f"h{i % 5}", "p", 0.2 + 0.6 * (i // 5 % 2)) for i in range(100)], table.schema)
    assert site_quality.site_means(equal)[1]["host"] > 1e5
    assert site_quality.site_means(table.limit(0))[1]["mean"] == 0.5


def test_sparse_sites_follow_their_parent(spark):
    """A document between two classes goes with its host; one on a new host keeps the text's probability."""
    weights = np.zeros(2 * len(logistic.STYLE) + 1)
    docs = spark.createDataFrame([(1, "x", "h", "p")], "doc_id long, text string, source string, lang string")
    assert site_quality.evidence(docs, weights, F.col("source"), F.col("lang")).first().p == 0.5


def test_quality_without_labels(corpus):
    docs, labels = corpus
    rows = site_quality.posterior(docs, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert len(rows) == docs.count() and all(r.p_text == pytest.approx(1 / 3) for r in rows)
    assert site_quality.posterior(docs.limit(0), labels, F.col("source"), F.col("lang")).collect() == []


def test_toxicity(corpus):
    docs, labels = corpus
    chain = toxicity_chain.train(docs, labels)
    assert set(ABUSE) <= set(list(chain.terms)[: chain.n_strong]) and len(chain.weights) == 3
    rows = toxicity_chain.score(docs, chain).collect()
    assert len(rows) == docs.count()
    assert all(r.toxic == (r.doc_id % 6 == 1) for r in rows if r.doc_id is not None and r.doc_id < 240)
    kept = toxicity_chain.without_toxic(docs, chain)
    assert kept.columns == docs.columns
    # the same decisions in the stage and in the scores
    clean = sorted(str(r.doc_id) for r in rows if not r.toxic)
    assert sorted(str(r.doc_id) for r in kept.collect()) == clean


def test_chain_feeds_earlier_categories_forward():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 3))
    first = (x[:, 0] > 0).astype(float)
    weights, held = toxicity_chain.fit_chain(x, np.stack([first, first], axis=1), np.arange(600) % 5)
    assert len(weights[0]) == 4 and len(weights[1]) == 5
    assert abs(weights[1][3]) > 1  # the earlier category's probability counts
    # out of fold: a model without the row's own fold made each probability
    out = np.arange(600) % 5 == 2
    expected = logistic.predict(x[out], logistic.fit(x[~out], first[~out]))
    assert np.allclose(held[out, 0], expected)


def test_toxicity_without_labels(corpus):
    docs, labels = corpus
    for some in (labels.limit(0), labels.where("toxic = 0")):
        chain = toxicity_chain.train(docs, some)
        assert toxicity_chain.without_toxic(docs, chain).count() == docs.count()
    assert toxicity_chain.score(docs.limit(0), chain).collect() == []


def test_long_text(spark, corpus):
    docs, labels = corpus
    chain = toxicity_chain.train(docs, labels)
    long = "the river runs. " * 40_000
    rows = [(1, long, "h", "en", ""), (2, long + " idiot moron scum idiot", "h", "en", "")]
    found = toxicity_chain.score(spark.createDataFrame(rows, docs.schema), chain).collect()
    assert {r.doc_id: r.toxic for r in found} == {1: False, 2: True}
