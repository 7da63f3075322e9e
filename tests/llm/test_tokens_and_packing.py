"""Word-wise ids against the library, packing and separator scan as exact round trips."""

import random
import tracemalloc
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from tablescope.llm import level_packing, separator_scan
from tablescope.llm.shared import new_folder, slices, written
from tablescope.llm.tokens import END_ID, WordIds, Words, vocabulary_path

ODD = [
    "", "   ", "a", "Él, ÀÇ.. þÐ! a!,.", "don't I'LL 's''s", "x<|endoftext|>y <|startoftext|>", "日本語 テキスト　全角",
    "a\x1cb\x85c\xa0d e", "é ́a á́b", "İstanbul ΑΣ Σίσυφος ς", "one two\nthree\tfour\r\nfive " * 400,
]


def library_ids(texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary_path()).encode_batch(texts, add_special_tokens=False)
    return [e.ids for e in found]


def test_word_ids_equal_those_of_whole_texts():
    rng = random.Random(4)
    pick = lambda: rng.choice([rng.randrange(32, 256), rng.randrange(160, 0x600), rng.randrange(0x900, 0x3100), 32, 10])
    texts = ODD + ["".join(chr(pick()) for _ in range(80)) for _ in range(300)]
    encoder = WordIds(keep=50)  # forgets words again and again
    for part in (texts[:100], texts[100:]):
        ids, bounds = encoder.of_texts(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == library_ids(part)


def test_letters_are_merged_once_for_all_ends():
    """Words that differ in case and in the signs they end in share one merge; their ids are the library's."""
    words = ["Sun", "sun", "sun.", "SUN!?", "sun***", "été", "Été,$,", "rain'", "rain's", "x1", "<|", "\u00b5m"]
    encoder, merged = WordIds(), []
    merge = encoder.merge
    encoder.merge = lambda letters: merged.append(letters) or merge(letters)
    found = encoder.of_words(words)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == library_ids(words)
    assert len(merged) == 3
    assert encoder.of_words(words) == found and len(merged) == 3


def test_words_of_texts():
    words = Words(pa.array([" a b  a\n", "", "b"]))
    found = [words.distinct[i] for i in words.index]
    assert found == ["a", "b", "a", "b"] and words.bounds.tolist() == [0, 3, 3, 4]


def check_packing(rows, texts, window):
    ids = [np.array([*x, 1], dtype="<u4") for x in library_ids([t or "" for t in texts])]
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[doc]) and p.length > 0
            assert p.ids_crc32 == crc32(ids[doc][p.start : p.start + p.length].tobytes())
            at += p.length
        assert at == len(ids[doc])
    for pieces in by_window.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return sum(window - sum(p.length for p in pieces) for pieces in by_window.values())


def test_packing_covers_every_id_once(spark):
    rng = random.Random(1)
    texts = [None, *ODD, *(" ".join(rng.choice(["sun", "rain", "wind"]) for _ in range(rng.randrange(900))) for _ in range(120))]
    rows = [(i, t, "k", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, start int").repartition(2)
    padding = check_packing(level_packing.pack(docs, window=256).collect(), texts, 256)
    assert padding <= 2 * 256  # one window of each partition
    assert check_packing(level_packing.pack(docs, window=256, max_open=3).collect(), texts, 256) >= 0


def test_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string").coalesce(1)
    found = level_packing.pack(docs).collect()
    assert sorted((r.doc_id or 0, r.length) for r in found) == [(0, 1), (1, 3), (1, 3)]
    assert level_packing.pack(docs.where("doc_id > 5")).collect() == []


def test_level_array_takes_the_least_sum_of_squares():
    rng = np.random.default_rng(2)
    for _ in range(200):
        window = int(rng.integers(4, 14))
        levels = level_packing.LevelArray(window)
        for w, h in enumerate(rng.integers(1, window, int(rng.integers(0, 12)))):
            levels.keep(w, int(h))
        size, count = int(rng.integers(1, window)), levels.count.copy()

        def total(level):
            after = count.copy()
            if level:
                after[level] -= 1
            if level + size < window:
                after[level + size] += 1
            return int((after[1:window] ** 2).sum())

        ways = {h: total(h) for h in range(1, window - size + 1) if count[h]}
        taken = levels.place(size)
        if taken is None:
            assert not ways or min(ways.values()) > total(0)
        else:
            level = int(np.flatnonzero(levels.count != count)[0])
            assert ways[level] == min(ways.values()) <= total(0)
            assert level == max(h for h, s in ways.items() if s == ways[level])


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    runs = {"a": [9, 9, END_ID, END_ID, 5, 5, 5, 5, 5, END_ID, 7], "b": [END_ID], "c": [1, 2, 3], "d": [4, END_ID]}
    for name, ids in runs.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "empty").write_bytes(b"")
    files = spark.createDataFrame([(str(tmp_path / n),) for n in [*runs, "empty"]], "file string")
    found = separator_scan.document_lengths(files, block_ids=block).collect()
    got = sorted((r.file[-1], r.ordinal, r.n_tokens, r.ended) for r in found)
    assert got == [
        ("a", 0, 2, True), ("a", 1, 0, True), ("a", 2, 5, True), ("a", 3, 1, False),
        ("b", 0, 0, True), ("c", 0, 3, False), ("d", 0, 1, True),
    ]


def test_token_counts_round_trip(spark):
    texts = [t for t in [None, *ODD] if not t or "<|" not in t]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "x"), (0, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string").repartition(3)
    found = [(r.doc_id, r.n_tokens) for r in separator_scan.count_tokens(docs).collect()]
    expected = [(i, len(x)) for i, x in enumerate(library_ids([t or "" for t in texts]))] + [(None, 2), (0, 0)]
    order = lambda rows: sorted(rows, key=str)
    assert order(found) == order(expected)
    assert separator_scan.count_tokens(docs.where("doc_id > 99")).collect() == []


def test_separators_inside_texts_are_counted(spark):
    texts = ["a b c", "x<|endoftext|>y <|startoftext|>", "<|endoftext|>", "<|endoftext|><|endoftext|> z", None, "sun", *ODD]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.n_tokens for r in separator_scan.count_tokens(docs).collect()}
    assert found == {i: len(x) for i, x in enumerate(library_ids([t or "" for t in texts]))}


def test_flat_files_hold_ids_alone(spark):
    docs = spark.createDataFrame([(1, "sun"), (2, "")], "doc_id long, text string").coalesce(1)
    files = written(separator_scan.write_flat(docs, new_folder(spark, "t")), "t")
    (name,) = {r.file for r in files.collect()}
    data = separator_scan.read_block(name, 0, 3, 100)
    assert data.tolist() == [*library_ids(["sun"])[0], END_ID, END_ID]


def test_memory_of_encoding(monkeypatch):
    """Packing encodes a large batch in parts, and words are forgotten before they take much: the worker stays small."""
    rng = random.Random(8)
    pool = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    texts = pa.RecordBatch.from_arrays([pa.array([" ".join(rng.choices(pool, k=1_000)) for _ in range(1_000)])], names=["text"])
    encoder = WordIds()
    encoder.of_words(pool)
    tracemalloc.start()
    for batch in slices([texts], "text", level_packing.SLICE_BYTES):
        encoder.of_texts(batch.column("text"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    monkeypatch.setattr(encoder, "new_word", lambda w: w.encode())
    for a in range(0, 1_200_000, 20_000):
        encoder.of_words([f"x{i}" for i in range(a, a + 20_000)])
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert peak < 60e6 and held < 60e6
