"""Divergences against a count in plain Python and against the SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tablescope.llm import divergence_audit as D
from tablescope.llm import queries


def slow(rows, least_docs, top=10):
    pattern = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = ["".join(c.lower() if c.isascii() else c for c in t) for t in pattern.findall(text)]
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ordered)]
    return sorted(out)


def sample(seed, n, sources):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcDEÉß漢" for b in ("x", "Y", "zz", "ö", "")]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "fr", None])
        skew = rng.randrange(1, len(words))
        text = "".join(rng.choice(words[:skew]) + rng.choice([" ", ", ", "\n", "7", "_"]) for _ in range(rng.randrange(25)))
        rows.append((rng.choice([text, text, text, None, "", "1 2 3"]), lang, rng.choice(["big", f"s{rng.randrange(sources)}", None])))
    return rows


@pytest.mark.parametrize(("group_block", "term_block"), [(32, 8192), (3, 4), (1, 1)])
def test_cells_add_up_to_the_whole(spark, group_block, term_block):
    rows = sample(group_block, 220, 9)
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "text string, lang string, source string, c int")
    got = D.divergences(docs.repartition(3), least_docs=4, group_block=group_block, term_block=term_block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == slow(rows, 4)


def test_sql_gives_the_same_rows(spark, tmp_path):
    rows = sample(5, 400, 5)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_divergence_audit(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.execute(queries.ORACLES["op12_divergence_audit"]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted) == slow(rows, 10)


def test_no_terms_no_rows(spark):
    rows = [("a b c", "en", "s1"), (None, "en", "s2"), ("", "en", None), ("d", None, None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in D.divergences(docs).collect()) == slow(rows, 10)
    assert {r.value for r in D.divergences(docs).collect()} == {0}
    assert D.divergences(docs.limit(0)).collect() == []


def test_shares_stay_exact_beyond_32_bits(spark):
    cases = [(0, 0, 1), (0, 3 * 10**15, 7), (10**15 + 1, 3 * 10**15, 12_345), (5, 5, 1), (123_456_789_012, 223_456_789_013, 10**6)]
    table = spark.createDataFrame(cases, "c long, n long, v long")
    got = [r.p for r in table.select(D.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()]
    assert got == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]


def test_terms_of_a_long_text(spark):
    text = "Alpha beta! " * 150_000 + "g4mma"
    rows = D.term_counts(spark.createDataFrame([(text, "en", "s")], "text string, lang string, source string")).collect()
    assert {(r.term, r.c, r.d) for r in rows} == {("alpha", 150_000, 1), ("beta", 150_000, 1), ("g", 1, 1), ("mma", 1, 1)}
