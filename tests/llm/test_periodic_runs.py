"""Runs against a search over all starts and periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tablescope.llm import periodic_runs as R
from tablescope.llm import queries


def slow_runs(words, least=12):
    """For every period the maximal stretches, without those that a smaller period explains."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                smallest = next(p for p in range(1, q + 1) if all(words[k] == words[k + p] for k in range(i, j + q - p)))
                if smallest == q:
                    out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def strings():
    rng = random.Random(11)
    yield from ([], [1], [1] * 40, [1, 2] * 20, [1, 2, 1] * 9, list(range(50)))
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    yield b[:90]  # Fibonacci words hold as many runs as few other texts
    for _ in range(250):
        letters = rng.choice([1, 2, 3, 8])
        base = [rng.randrange(letters) for _ in range(rng.randrange(1, 70))]
        if rng.random() < 0.6:
            p = base[: rng.randrange(1, 9)]
            at = rng.randrange(len(base))
            base[at:at] = p * rng.randrange(1, 9) + p[: rng.randrange(len(p) + 1)]
        yield base


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_are_those_of_all_periods(least):
    for words in strings():
        assert [tuple(r) for r in R.runs_of(np.array(words, dtype=np.int64), least).tolist()] == slow_runs(words, least)


def test_common_extensions():
    rng = random.Random(3)
    for _ in range(60):
        word = [rng.randrange(1, 4) for _ in range(rng.randrange(2, 60))] + [0]
        tree = R.CommonExtension(word)
        assert [int(x) for x in np.argsort(tree.rank)] == sorted(range(len(word)), key=lambda i: word[i:])
        pairs = [(i, j) for i in range(len(word)) for j in range(i + 1, len(word))]
        a, b = np.array(pairs).T
        expected = [next(k for k in range(len(word)) if word[i + k] != word[j + k]) for i, j in pairs]
        assert tree.common(a, b).tolist() == expected


def test_parts_of_a_batch_hold_every_run():
    rng = random.Random(8)
    texts = [list(map(int, t)) for t in strings()]
    for t in texts[::3]:  # words that never repeat between repeated parts
        t[len(t) // 2 : len(t) // 2] = rng.sample(range(100, 1000), 9)
    index = np.array([w for t in texts for w in t])
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for least in (12, 13, 20):
        found = R.runs_in_batch(index, bounds, least)
        for i, t in enumerate(texts):
            assert [tuple(r) for r in found.get(i, np.empty((0, 3), int)).tolist()] == slow_runs(t, least)


def planted(key, text):
    words = (text or "").split()
    h, n = zlib.crc32(str(key).encode()), len(words)
    g = h // 10
    if key is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digests(key, text):
    words = planted(key, text)
    runs = slow_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        key, len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query(spark, tmp_path):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gämma", "delta"] + [f"w{i}" for i in range(300)]
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (None, "no key " * 9, 1), (5, "one two " * 400, 1), (5, "one two " * 400, 1)]
    rows += [(i, " ".join(rng.choices(words, k=rng.randrange(1, 150))), 2) for i in range(10, 150)]
    rows += [(i, "\n".join([" ".join(rng.choices(words, k=4))] * 5 + rng.choices(words, k=20)), 2) for i in range(150, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns[:8] == columns
    order = lambda r: str(r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=order) == sorted(
        (digests(k, t) for k, t, _ in rows), key=order
    )


def test_long_text_and_no_rows(spark):
    long = " ".join(f"w{i % 700}" for i in range(120_000)) + " end"
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    row = R.find_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(0, 120_000, 700)]
    assert row.collapsed.split() == [f"w{i}" for i in range(700)] + ["end"]
    assert R.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        R.find_runs(docs, least=1)
