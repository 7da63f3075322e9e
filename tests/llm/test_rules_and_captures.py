"""Divergence rules and the capture index against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablescope.llm import capture_index as C
from tablescope.llm import divergence_rules as D
from tablescope.llm.shared import new_folder

SCHEMA = "doc_id long, text string, lang string, words string, n_words int"


def texts():
    rng = random.Random(7)
    some = D.COMMON["en"].split() + ["river", "Stone", "cloud", "É", "x1"]
    out = [" ".join(rng.choice(some) for _ in range(rng.randrange(200))) for _ in range(40)]
    out += ["", None, "one", "a b", "a b c", "a b c a b c", "a a a a a", "x y\n\nx y\nx  y\n \n \nx y", "#$%& <tag> |||"]
    return out + ["the same four words " * 400, " ".join(str(i) for i in range(3000)), "  no break spaces \x1c"]


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def test_counts(spark):
    rows = [(i, t, "en", "c", 1) for i, t in enumerate(texts())] + [(None, "a b", None, "c", 1), (0, texts()[0], "EN", "c", 1)]
    found = D.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted([(str(r.doc_id), *(r[n] for n in names)) for r in found])
    assert got == sorted([(str(r[0]), *slow_counts(r[1])) for r in rows])
    assert not any(r.base_failed and r.kept for r in found)
    assert D.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_classes_and_common_words_in_one_pass(spark):
    """Histograms against Python's own, with marks around words, other blanks and letters that change when lower-cased; runs
    and common words are matched in the text, not character by character or word by word."""
    import unicodedata

    some = ["The", "(the)", "they,", "'AND'", "x.and", "of:the", "İs", "\u212aan", "für,", "FÜR", "dass", "ß", "\xa0the", "", "."]
    rng = random.Random(9)
    rows = [(i, rng.choice("\t\n \x0b\x0c\r").join(rng.choices(some, k=60)), rng.choice(["en", "De", "xx", None])) for i in range(80)]
    rows += [(100, " the the\tthe", "en"), (101, "\n", "en"), (102, "", "de"), (103, "den", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = {i: (t, (lang or "").lower()) for i, t, lang in rows}
    for r in D.text_counts(docs).collect():
        text, lang = texts[r.doc_id]
        words = [w.strip(".,;:!?\"'()").lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        assert list(r.word_bins) == [words.count(w) for w in D.COMMON.get(lang, "").split()], text
        kinds = Counter({"Ll": 0, "Lu": 1, "Nd": 2}.get(unicodedata.category(c), 3 if c in D.BLANKS else 5) for c in text)
        kinds[4] = len(re.findall(r"[#*$%&|<>]", text))
        assert list(r.class_bins) == [kinds[k] for k in range(4)] + [kinds[4], kinds[5] - kinds[4]]
    plan = D.text_counts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and "p{Ll}+" in plan


def test_distance_by_hand(spark):
    a, b = [4, 0, 6], [1, 2, 7]
    row = spark.createDataFrame([(a, b, [0, 0, 0])], "a array<bigint>, b array<bigint>, z array<bigint>")
    ten, none = F.lit(10), F.lit(0)
    got = row.select(
        D.distance(F.col("a"), ten, F.col("b"), ten).alias("ab"), D.distance(F.col("b"), ten, F.col("a"), ten).alias("ba"),
        D.distance(F.col("a"), ten, F.col("a"), ten).alias("aa"), D.distance(F.col("z"), none, F.col("a"), ten).alias("za"),
    ).first()
    p, q = [x / 10 for x in a], [x / 10 for x in b]
    half = lambda x, y: sum(u * math.log2(2 * u / (u + v)) for u, v in zip(x, y) if u)
    assert got.ab == pytest.approx(math.sqrt((half(p, q) + half(q, p)) / 2)) == got.ba
    assert got.aa == 0 and got.za == pytest.approx(math.sqrt(0.5))


def test_verdicts_and_guards(spark):
    rng = random.Random(2)
    common = D.COMMON["en"].split()
    usual = lambda n: " ".join(rng.choice(common + [f"w{rng.randrange(500)}"] * 20) for _ in range(n))
    rows = [(i, usual(300), "en") for i in range(60)]
    rows += [(100, usual(300).upper(), "en"), (101, " ".join(f"q{i}" for i in range(300)), "en"), (102, usual(80), "en")]
    rows += [(103, " ".join(f"q{i}" for i in range(300)), "xx"), (104, "a#%* " * 20 + usual(100).replace(" ", "%%% "), "en")]
    found = D.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_words=0.4).collect()
    kept = {r.doc_id: r.kept for r in found}
    assert all(kept[i] for i in range(60)) and kept[102] and kept[103]
    assert not kept[100] and not kept[101] and not kept[104]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")
    plan = D.judge(docs)._jdf.queryExecution().executedPlan().toString()
    counts = D.text_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan + counts)


def test_reversed_hosts():
    assert C.reversed_host("https://www.Shop.example.org:8080/a?b=1#c") == "org,example,shop,www:8080)/a?b=1"
    assert C.reversed_host("http://example.org") == C.reversed_host("https://example.org:443/") == "org,example)/"
    assert C.reversed_host("http://10.0.0.1/x") == "10.0.0.1)/x"
    assert C.reversed_host(None) == C.reversed_host("") == ""
    assert C.reversed_host("no url") == "no url" and C.reversed_host("http://[bad") == "http://[bad"


def test_records_round_trip():
    body = "é\r\n\r\n<p>".encode() * 9
    data = C.record(7, "http://a\nb", body, hashlib.sha256(body).hexdigest(), None)
    found = C.parse(data)
    assert found["payload"] == body and found["page_id"] == 7 and found["record_type"] == "response"
    with pytest.raises(ValueError, match="digest"):
        C.parse(C.record(7, None, body + b"x", hashlib.sha256(body).hexdigest(), None))


PAGES = "page_id long, url string, html string, file string, key int"


def pages():
    rng = random.Random(3)
    same, twin = "<p>" + "equal " * 40, "y" * 100
    rows = [(i, f"http://h{i % 9}.example.org/{i}", f"<p>{rng.random()}" * rng.randrange(1, 30)) for i in range(300)]
    rows += [(1000 + i, "http://hot.example.org/", same) for i in range(700)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "http://x.org/é?ü", "z" * 99), (2003, "http://x.org/", "z" * 99)]
    rows += [(2010, "http://t.org/1", twin), (2005, "http://t.org/2", twin), (2005, "http://t.org/2", twin), (None, "http://t.org/3", twin)]
    rows += [(2020, "http://big.org/", "<b>é</b>" * 200_000)]
    return [(*r, "c", 1) for r in rows]


def slow_records(rows):
    first = {}
    for i, _, html, *_ in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        to = first.get(html) if len(data) >= 100 and first.get(html) != i else None
        out.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", str(to)))
    return sorted(out)


def test_pages_through_archives_and_index(spark):
    table = spark.createDataFrame(pages(), PAGES).repartition(3)
    found = C.archive_and_read_back(table).collect()
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in found)
    assert got == slow_records(pages())
    assert C.archive_and_read_back(table.limit(0)).collect() == []


def test_look_up_of_some_keys(spark):
    table = spark.createDataFrame(pages(), PAGES).repartition(2)
    folder = new_folder(spark, "t")
    records = C.write_archives(table, folder)
    index = C.build_index(records, folder)
    keys = ["org,example,hot)/", "org,example,h1)/1", "nowhere", "", "zz", None]
    asked = spark.createDataFrame([(k,) for k in keys], "key string")
    found = Counter(r.key for r in C.look_up(index, asked).collect())
    assert found == {"org,example,hot)/": 700, "org,example,h1)/1": 1, "": 2}


def test_binary_search_over_blocks(tmp_path):
    rng = random.Random(1)
    lines = sorted([f"k{rng.randrange(40):02d}", i, "f", i, 1] for i in range(500))
    data, directory = b"", []
    for a in range(0, len(lines), 7):
        block = C.pack_block(lines[a : a + 7])
        directory.append((lines[a][0], len(data), len(block)))
        data += block
    tail = C.pack_block(directory)
    path = tmp_path / "i"
    path.write_bytes(data + tail + C.struct.pack(C._FOOTER, len(data), len(tail)))
    index = C.IndexFile(str(path))
    for key in [f"k{i:02d}" for i in range(41)] + ["", "a", "z"]:
        assert list(index.find(key)) == [x for x in lines if x[0] == key]
