"""The base against brute force; the model against numeric slopes and a plain forward pass."""

import math
import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from tablescope.llm import causal_lm as L
from tablescope.llm.tokens import END_ID, N_IDS, word_ids


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def words(text):
    return [w.decode() for w in lower(text).encode().split()]


def corpus():
    rng = random.Random(5)
    vocabulary = ["Sun", "rain,", "É", "wind", "snow", "hail", "fog.", "mist"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    return list(enumerate([*texts, None, "", " \n ", "only here once", "long word " * 3000])) + [(None, "sun sun"), (3, "rain, É")]


def slow_base(rows):
    held = {i: i is not None and crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    seen: dict = {}
    for i, t in rows:
        if not held[i]:
            for w in [*words(t or ""), None]:
                seen[w] = seen.get(w, 0) + 1
    n, d = sum(seen.values()), sum(seen.values()) + 0.5 * (len(seen) + 1)
    out = []
    for i, t in rows:
        tokens = [*words(t or ""), None]
        score = sum(math.log10((seen.get(w, 0) + 0.5) / d) for w in tokens)
        out.append((str(i), held[i], len(tokens), sum(w in seen for w in tokens), n, round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("frequent", [0, 20, 10_000])
def test_base_equals_brute_force(spark, frequent):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string").repartition(3)
    found = L.score_texts(docs, steps=3, frequent_words=frequent).collect()
    got = sorted(
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found
    )
    assert got == slow_base(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


@pytest.mark.parametrize("hold", [1, 30, 1_000_000])
def test_words_are_counted_however_few_are_held(spark, hold):
    rows = corpus()
    seen = [w for _, t in rows for w in words(t or "")]
    docs = spark.createDataFrame([(t,) for _, t in rows], "text string").repartition(3)
    found = L.word_counts(docs, hold=hold).collect()
    assert {r.word: r.c for r in found} == {w: seen.count(w) for w in set(seen)} and len(found) == len(set(seen))


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_sums_keep_their_type(kind):
    """Sums of rows by number, also of numbers that do not occur, in the kind of the weights they belong to."""
    rng = np.random.default_rng(6)
    at, rows = rng.integers(0, 9, 50) * 2, rng.standard_normal((50, 3)).astype(kind)
    got = L.sums_by(at, rows, 20)
    assert got.dtype == kind
    assert np.allclose(got, [rows[at == k].sum(axis=0) for k in range(20)], atol=1e-5)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.score_texts(docs, steps=2).collect() == []
    only = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert crc32(b"1") % 5 != 1 or L.score_texts(only, steps=2).first().train_tokens == 0


def batch(texts):
    ids, bounds = word_ids().of_texts(pa.array(texts))
    counts = np.bincount(ids, minlength=N_IDS).astype(float)
    counts[END_ID] += len(texts)
    return ids, bounds, L.Classes.from_counts(counts)


def stored(ids, bounds):
    return [ids[a:b].astype("<u2").tobytes() for a, b in zip(bounds, bounds[1:])]


def test_classes_are_a_distribution():
    rng = np.random.default_rng(0)
    classes = L.Classes.from_counts(rng.integers(0, 50, N_IDS).astype(float))
    assert classes.of_id.min() == 0 and classes.of_id.max() == L.CLASSES - 1
    total = np.bincount(classes.of_id, weights=np.exp(classes.within.astype(float)))
    assert np.allclose(total, 1, atol=1e-4)
    assert np.isclose(np.exp(classes.log_share.astype(float)).sum(), 1, atol=1e-4)


def test_class_pairs_of_all_training_texts(spark, monkeypatch):
    """Starts, ends and texts beyond the sampled windows are counted too."""
    texts = [t or "" for _, t in corpus()]
    ids, bounds, classes = batch([lower(t) for t in texts])
    expected = np.zeros((L.CLASSES + 1, L.CLASSES), int)
    for a, b in zip(bounds, bounds[1:]):
        read = [L.START_CLASS, *classes.of_id[ids[a:b]]]
        np.add.at(expected, (read, classes.of_id[[*ids[a:b], END_ID]]), 1)
    docs = spark.createDataFrame(list(enumerate(stored(ids, bounds))), "doc_id long, ids binary").repartition(3)
    assert np.array_equal(L.pair_counts(docs, classes), expected)

    given, fit = [], L.fit_attention
    monkeypatch.setattr(L, "LEAST_DOCS", 1)
    monkeypatch.setattr(L, "fit_attention", lambda *a: given.append(a[3]) or fit(*a))
    L.score_texts(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string"), steps=1).count()
    assert given[0].sum() == len(ids) + len(texts)


def test_windows_score_each_id_once():
    ids, bounds, classes = batch([t or "" for _, t in corpus()])
    read, to_come, text = L.streams(ids, bounds, classes.of_id)
    assert len(to_come) == len(ids) + len(bounds) - 1
    assert np.array_equal(np.bincount(text), np.diff(bounds) + 1)
    keys, texts = L.windows(read, text)
    queries = keys[:, L.CONTEXT - L.STRIDE :].reshape(-1)[: len(read)]
    assert np.array_equal(queries, read) and len(keys) == -(-len(read) // L.STRIDE)


def test_scores_equal_a_plain_forward_pass():
    texts = [t or "" for _, t in corpus()][:20] + ["", "sun"]
    ids, bounds, classes = batch(texts)
    model = L.Attention(classes.log_share)
    rng = np.random.default_rng(1)
    for n in ("r", "s", "d", "gs", "gd"):
        model.w[n] = model.w[n] + rng.standard_normal(model.w[n].shape).astype(np.float32) * 0.3
    got = L.log_probabilities(model.tables(), classes, ids, bounds, chunk=3)
    w = {n: p.astype(float) for n, p in model.w.items()}
    places = np.concatenate([[0], np.cumsum(np.diff(bounds) + 1)])
    for t, (a, b) in enumerate(zip(bounds, bounds[1:])):
        target = [*ids[a:b].tolist(), END_ID]
        read = [L.START_CLASS, *classes.of_id[ids[a:b]]]
        total = 0.0
        for i in range(len(target)):
            where = places[t] + i  # windows begin at multiples of the stride of the whole batch
            low = where - where % L.STRIDE - (L.CONTEXT - L.STRIDE)
            seen = [j for j in range(i + 1) if places[t] + j >= low]
            x = w["e"][[read[j] for j in seen]]
            s = (w["e"][read[i]] @ w["q"]) @ (x @ w["k"]).T / math.sqrt(L.WIDTH) + w["r"][[i - j for j in seen]]
            p = np.exp(s - s.max())
            h = w["e"][read[i]] + (p / p.sum()) @ (x @ w["v"])
            z = h + np.maximum(h @ w["a"] + w["b"], 0) @ w["c"]
            c = classes.of_id[target[i]]
            group = c // L.GROUP
            coarse = z @ w["gu"] + w["gs"] + w["gd"][read[i]]
            fine = (z @ w["u"] + w["s"] + w["d"][read[i]])[group * L.GROUP : (group + 1) * L.GROUP]
            total += coarse[group] - np.logaddexp.reduce(coarse) + fine[c % L.GROUP] - np.logaddexp.reduce(fine)
            total += classes.within[target[i]]
        assert got[t] == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    model = L.Attention(np.zeros(L.CLASSES))
    model.w = {n: p.astype(float) for n, p in model.w.items()}
    keys = rng.integers(0, L.CLASSES + 1, (5, L.CONTEXT))
    valid = rng.random((5, L.CONTEXT)) < 0.8
    valid[:, L.CONTEXT - L.STRIDE :] = True
    target = rng.integers(-1, L.CLASSES, (5, L.STRIDE))
    _, slopes = model.gradients(keys, valid, target)
    for n, p in model.w.items():
        flat = p.reshape(-1)
        for at in rng.integers(0, flat.size, 6):
            if n in ("e", "d", "gd"):  # a row that occurs
                at = int(keys[0, -1]) * p.shape[1] + int(at) % p.shape[1]
            kept, step = flat[at], 1e-5
            flat[at] = kept + step
            up, _ = model.gradients(keys, valid, target)
            flat[at] = kept - step
            down, _ = model.gradients(keys, valid, target)
            flat[at] = kept
            assert slopes[n].reshape(-1)[at] == pytest.approx((up - down) / (2 * step), abs=2e-5, rel=2e-3)


def test_training_beats_the_share_of_classes():
    rng = np.random.default_rng(4)
    keys = np.cumsum(np.ones((400, L.CONTEXT), int), axis=1) + rng.integers(0, 10, (400, 1))
    target = keys[:, L.CONTEXT - L.STRIDE :] + 1
    model = L.Attention(np.zeros(L.CLASSES))
    losses = model.train(keys, np.ones(keys.shape, bool), target, steps=40, batch=64)
    assert losses[-1] < 0.5 * math.log(L.CLASSES)


def test_more_documents_change_the_weights(spark, monkeypatch):
    """What attention sees grows with the corpus, also over several trainers and rounds of adding up."""
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["sun", "rain", "fog", "hail", "wind"], k=60)) for _ in range(400)]
    ids, bounds, classes = batch(texts)
    docs = spark.createDataFrame(list(enumerate(stored(ids, bounds))), "doc_id long, ids binary").repartition(4)
    monkeypatch.setattr(L, "LEAST_DOCS", 1)
    monkeypatch.setattr(L, "TRAIN_SHARE", 4)
    monkeypatch.setattr(L, "TRAINER_WINDOWS", 20)
    monkeypatch.setattr(L, "TOGETHER", 3)
    pairs = np.zeros((L.CLASSES + 1, L.CLASSES))
    counts, weights = [], []
    for n in (100, 400):
        windows = L.training_windows(docs.where(f"doc_id < {n}"), n, classes).cache()
        counts.append(windows.count())
        weights.append(L.fit_attention(windows, classes.log_share, 50, pairs).packed())
    assert 2.5 < counts[1] / counts[0] < 6
    assert np.isfinite(weights[0]).all() and np.abs(weights[0] - weights[1]).max() > 1e-3


def test_context_is_learnt(spark):
    """Where a word depends on one two places before, texts score better than by their words alone."""
    rng = random.Random(2)
    names, rows = ["alpha", "bravo", "delta", "gamma", "kappa", "sigma", "omega", "theta"], []
    for i in range(600):
        first = rng.choices(names, k=2)
        for _ in range(60):
            first.append(names[(names.index(first[-2]) + 3) % 8])
        rows.append((i, " ".join(first)))
    found = L.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("held_out").collect()
    assert sum(r.score for r in found) > 0.5 * sum(r.base_score for r in found)


def test_all_training_texts_are_learnt_from(spark, monkeypatch):
    """The rounds begin with a share; every window of every training text is then learnt from, held-out ones from none."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["sun", "rain", "fog", "hail", "wind"], k=40))) for i in range(300)]
    monkeypatch.setattr(L, "LEAST_DOCS", 1)
    monkeypatch.setattr(L, "BATCH", 64)
    given, seen, share, learn = [], [], L.training_windows, L.trained_on_all
    monkeypatch.setattr(L, "training_windows", lambda *a: given.append(share(*a)) or given[-1])
    monkeypatch.setattr(L, "trained_on_all", lambda *a: seen.append((a[0], learn(*a))) or seen[-1][1])
    found = L.score_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), steps=2).collect()
    assert len(found) == 300 and all(math.isfinite(r.score) for r in found)
    train, parts = seen[0]
    sizes = [len(r.ids) // 2 + 1 for r in train.collect()]
    assert len(sizes) == sum(not r.held_out for r in found)
    assert sum(r.windows for r in parts.collect()) == -(-sum(sizes) // L.STRIDE) > 5 * given[0].count()


def test_a_text_beyond_the_share_changes_the_model(spark):
    """The mean over tasks moves with every document's windows, also where several tasks learn."""
    ids, bounds, classes = batch(["sun rain fog " * 30, "hail wind hail " * 30, "fog fog sun " * 30])
    rows = list(enumerate(stored(ids, bounds)))
    packed = []
    for n in (2, 3):
        docs = spark.createDataFrame(rows[:n], "doc_id long, ids binary").repartition(2, "doc_id")
        packed.append(L.learn_from_all(docs, L.Attention(classes.log_share), classes).packed())
    assert np.isfinite(packed).all() and np.abs(packed[0] - packed[1]).max() > 1e-4
