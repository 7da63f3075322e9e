"""Passage search against the full table of edit distances."""

import random

from tablescope.llm import pigeonhole as P


def slow(passage, text):
    """Least edits of the passage against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def noisy(rng, passage, edits):
    out = list(passage)
    for _ in range(edits):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.pop(at), lambda: out.insert(at, "q"), lambda: out.__setitem__(at, "z")])()
    return "".join(out)


def test_myers_equals_the_table():
    rng = random.Random(6)
    for _ in range(200):
        passage = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randrange(120)))
        masks = P.Passages([(0, passage)], 0.0).mask(0)
        least = slow(passage, text)
        hit = P.myers(masks, len(passage), text, len(passage))
        assert hit is None if not text and least > len(passage) else (hit[0] if text else least) == least
        assert P.myers(masks, len(passage), text, least - 1) is None


def test_search_finds_what_the_budget_allows():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(4, 30)))) for i in range(12)]
    block = P.Passages(items, 0.1)
    for _ in range(150):
        _, passage = rng.choice(items)
        inside = noisy(rng, passage, rng.randrange(14))
        text = P.plain(" ".join([rng.choice(words), inside, rng.choice(words)]))
        expected = {i: slow(t, text) for i, (_, t) in enumerate(items)}
        expected = {i: e for i, e in expected.items() if e <= P.budget(items[i][1], 0.1)}
        assert {i: e for i, (e, _) in block.search(text).items()} == expected


def test_pieces_cover_the_passage():
    for n in (1, 2, 19, 20, 57):
        text = "".join(chr(97 + i % 26) for i in range(n))
        for k in range(min(n, 9)):
            parts = list(P.pieces(text, k))
            assert len(parts) == k + 1 and "".join(p for _, p in parts) == text
            assert all(text.startswith(p, a) and p for a, p in parts)


PASSAGES = [(1, "The quick brown fox jumps over the lazy dog"), (2, "short one"), (3, None), (None, "A passage that has no number at all"), (4, "The quick brown fox jumps over the lazy dog")]


def test_documents(spark):
    rows = [
        (1, "so THE quick\nbrown fox  jumps over the lazy dog it was", 0),
        (2, "the quick brown fax jumps over the lazy do", 0),
        (3, "the quick brown cat sleeps beside the dog", 0),
        (4, None, 0), (5, "", 0), (None, "a passage that has no number at all", 0), (6, "short one", 0),
        (7, "filler " * 30_000 + PASSAGES[0][1], 0), (7, "the quick brown fox jumps over the lazy dog", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(PASSAGES, "item_id long, text string")
    for size in (10, 4_000_000):  # many blocks, one block
        found = P.find_passages(docs, bench, block_chars=size)
        got = sorted((r.doc_id or 0, r.item_id or 0, r.edits) for r in found.collect())
        assert got == [(0, 0, 0), (1, 1, 0), (1, 4, 0), (2, 1, 2), (2, 4, 2), (6, 2, 0), (7, 1, 0), (7, 1, 0), (7, 4, 0), (7, 4, 0)]
        kept = P.without_passages(docs, bench, block_chars=size)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id or 0 for r in kept.collect()) == [3, 4, 5]


def test_short_items_match_whole_words_only():
    block = P.Passages([(1, "2 + 2 = 4"), (2, "what is pi?"), (3, ""), (4, "ox")], 0.3)
    found = lambda text: {block.items[n][0]: hit for n, hit in block.search(P.plain(text)).items()}
    assert found("So 2 + 2 =  4.") == {1: (0, 12)}
    assert found("12 + 2 = 4, 2 + 2 = 40, boxes, fox") == {}
    assert found("boxes and an Ox; what is pi? three") == {2: (0, 28), 4: (0, 15)}
    assert found("what is pi") == {} == found("")


def test_a_task_holds_one_block(spark, monkeypatch):
    items = [(i, f"passage number {i:03d} of the three blocks") for i in range(3)]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in items] + [(9, "clean")], "doc_id long, text string")
    blocks = [[(i, P.plain(t))] for i, t in items]
    monkeypatch.setattr(P, "passage_blocks", lambda *a: iter(blocks))
    kept = P.without_passages(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [9]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "searched" in plan
    for i, b in enumerate(blocks):
        P.held_block(str(i), b, 0.1, 20)
        assert len(P._BLOCKS) == 1


def test_no_passages_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "any text that is long enough")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert P.find_passages(docs, none).collect() == []
    assert P.without_passages(docs, none).count() == 1
    assert P.find_passages(docs.limit(0), spark.createDataFrame(PASSAGES, "item_id long, text string")).collect() == []
