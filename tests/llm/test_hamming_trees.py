"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablescope.llm import hamming_trees as H


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(points, radius=2):
    parent = {p: p for p in points}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, p in enumerate(points):
        for q in points[:i]:
            if (p ^ q).bit_count() <= radius:
                parent[max(root(p), root(q))] = min(root(p), root(q))
    return {p: root(p) for p in points}


def clustered(seed, n):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(2, n // 40))]
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        p = rng.choice(centres)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            p ^= 1 << rng.randrange(64)
        out.append(p)
    return out


def test_fingerprint_bits():
    rng = random.Random(3)
    texts = ["", " \t\n", "one", "one Two", "A b c", "ÄÖ É ß x", "a b c " * 700]
    texts += [" ".join(rng.choice("abcdeÉ") for _ in range(rng.randrange(60))) for _ in range(50)]
    for t in texts:
        assert H.fingerprint(t.encode()) == slow_fingerprint(t)


def test_majority_adds_up_in_parts():
    hashes = np.random.default_rng(4).integers(0, 2**63, 2 * H.SPREAD + 777, dtype=np.uint64) * np.uint64(2)
    bits = [int(2 * ((hashes >> np.uint64(i)) & np.uint64(1)).sum() > len(hashes)) << i for i in range(64)]
    assert H.majority(hashes) == sum(bits)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block", [4, 32])
def test_links_connect_exactly_the_near_points(seed, block):
    points = sorted(set(clustered(seed, 400)))
    a, b = H.links(np.array(points, dtype=np.uint64), block=block)
    expected = slow_components(points)
    assert all((expected[int(x)] == expected[int(y)]) for x, y in zip(a, b))
    parent = {p: p for p in points}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for x, y in zip(a.tolist(), b.tolist()):
        parent[max(root(x), root(y))] = min(root(x), root(y))
    assert {p: root(p) for p in points} == expected


def test_points_that_no_bound_splits():
    points = np.array([1 << b for b in range(60)], dtype=np.uint64)  # all two bits apart
    a, b = H.links(points, block=8)
    assert set(a.tolist()) | set(b.tolist()) == set(points.tolist())


def test_near_points_share_a_shard():
    points = np.array(sorted(set(clustered(9, 600))), dtype=np.uint64)
    tree, n = H.build_tree(points[::3], 20)
    shards = {}
    for shard, at in H.route(points, tree):
        for i in at:
            shards.setdefault(int(i), set()).add(shard)
    assert n > 3 and len(shards) == len(points)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    for i, j in zip(*np.nonzero(near)):
        assert shards[int(i)] & shards[int(j)]


def as_signed(points):
    return [p - (1 << 64) if p >> 63 else p for p in points]


def test_components_over_shards(spark):
    points = sorted(set(clustered(5, 500)))
    table = spark.createDataFrame([(p,) for p in as_signed(points)], "fp long").repartition(3)
    labels = H.components(H.near_links(table, shard_rows=60))
    got = {r.node % (1 << 64): r.label for r in labels.collect()}
    expected = slow_components(points)
    groups = {}
    for p in points:
        groups.setdefault(expected[p], []).append(p)
    for members in groups.values():
        if len(members) > 1:
            assert {got[p] for p in members} == {min(as_signed(members))}
        else:
            assert members[0] not in got


def test_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.label for r in H.components(pairs).collect()} == {0}


DOCS = "doc_id long, text string, fp string, label int"


def documents():
    rng = random.Random(8)
    base = [" ".join(rng.choice(["sun", "rain", "wind", "snow", "hail", "fog"]) for _ in range(200)) for _ in range(30)]
    texts = base + base[:10] + [b.replace("sun rain", "sun  rain", 1).upper() for b in base[5:9]] + ["", None, " ", "x y"]
    rows = [(i + 1, t, "f", 1) for i, t in enumerate(texts)]
    return rows + [(None, base[0], "f", 1), (None, "only here without id", "f", 1), (3, base[2], "f", 1)]


def test_document_components(spark):
    rows = documents()
    found = H.document_components(spark.createDataFrame(rows, DOCS).repartition(3), shard_rows=10)
    got = sorted((r.doc_id or -1, r.fp % (1 << 64), r.component_id or -1) for r in found.collect())
    prints = [slow_fingerprint(r[1] or "") for r in rows]
    group = slow_components(sorted(set(prints)))
    first = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            first[group[p]] = min(first.get(group[p], r[0]), r[0])
    assert got == sorted((r[0] or -1, p, first.get(group[p], -1)) for r, p in zip(rows, prints))
    assert H.document_components(spark.createDataFrame([], DOCS)).collect() == []


def test_one_of_each(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    kept = H.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    members = H.document_components(docs)
    wanted = {r.component_id for r in members.select("component_id").distinct().collect()}
    assert len(ids) == len(set(ids)) and set(ids) == wanted


def test_one_of_each_with_repeated_and_missing_keys(spark):
    far = ["sun rain wind " * 50, "fog hail snow " * 50, "mist ice storm " * 50]
    rows = [(5, far[0]), (5, far[0]), (5, far[1]), (7, far[1]), (None, far[0]), (None, far[2]), (None, far[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.text[:3]) for r in H.one_of_each(docs).collect())
    assert got == [(0, "mis"), (5, "fog"), (5, "sun")]
    assert H.one_of_each(docs.limit(0)).collect() == []


def test_hexadecimal(spark):
    row = spark.createDataFrame([(-1,), (10,)], "fp long").select(H.hex_digits("fp").alias("x"), F.lit(1)).collect()
    assert [r.x for r in row] == ["f" * 16, "000000000000000a"]
