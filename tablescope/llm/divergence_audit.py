"""How far the sources of a language lie from each other and from the language, over exact term counts.

A group is a source within a language. Each language keeps the terms found in at least ``LEAST_DOCS`` of its documents.
A group's share of a term is p = 1 + floor(10**9 (count + 2) / (N + 2 V)), N being its occurrences of the V kept terms; the
divergence of two groups sums floor((p - q)**2 / (p + q)) over all kept terms of the language. All of it is whole
numbers: the quotient is taken in three steps of a thousand, so nothing exceeds 64 bits below N + 2 V = 9 * 10**15.

Pairs are computed over a cube. The groups of a language are dealt to blocks of ``GROUP_BLOCK``, its kept terms to blocks of
about ``TERM_BLOCK``; a task owns a cell (group block, group block, term block) and gets the two slices (group block,
term block) that it compares, so a slice is copied once for every group block of the language and neither the groups nor
the terms of one are ever together in a task. A cell's partial sums are added up along the term axis. Within a cell a
group is a row of a small dense table, in which terms that it lacks have its share of nothing.

Counting is one pass over the texts: tasks add up (language, source, term) over many documents, and one shuffle by
(language, term) brings occurrences and document counts together.

NULL text, language and source are empty strings. Every occurring group takes part, also without terms. Repeated rows
count as documents of their own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.shared import as_text, slices, written
from tablescope.llm.tokens import Words

SCALE = 1_000_000_000
ADDED = 2
LEAST_DOCS = 10
TOP_TERMS = 10
GROUP_BLOCK = 32
TERM_BLOCK = 8_192

#: Letters A to Z become small; every other ASCII byte but a to z separates terms. Bytes of longer characters stay.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def only_letters(texts: pa.Array) -> pa.Array:
    """The texts with a blank for every byte that is no part of a term, all bytes of the batch at once."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    data = pa.py_buffer((data.to_pybytes() if data else b"").translate(_LETTERS))
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, data], offset=texts.offset)


def term_counts(docs: DataFrame, hold: int = 400_000) -> DataFrame:
    """Rows (lang, source, term, c, d): occurrences and documents, summed within tasks ``hold`` rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], dict[str, list[int]]] = {}
        held = 0

        def rows() -> pa.RecordBatch:
            flat = [(g, t, v) for g, terms in seen.items() for t, v in terms.items()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([g[0] for g, _, _ in flat], pa.string()), pa.array([g[1] for g, _, _ in flat], pa.string()),
                    pa.array([t for _, t, _ in flat], pa.string()), pa.array([v[0] for _, _, v in flat], pa.int64()),
                    pa.array([v[1] for _, _, v in flat], pa.int64()),
                ],
                names=["lang", "source", "term", "c", "d"],
            )

        for batch in slices(batches, "text", 4_000_000):
            words = Words(only_letters(batch.column("text")))
            n = len(words.distinct)
            names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            groups = {g: i for i, g in enumerate(dict.fromkeys(names))}
            owner = np.array([groups[g] for g in names], dtype=np.int64)
            text = np.repeat(np.arange(len(names)), np.diff(words.bounds))
            # documents first: each (text, term) once, with its occurrences
            cells, times = np.unique(text * n + words.index, return_counts=True)
            place, index = np.unique(owner[cells // max(n, 1)] * n + cells % max(n, 1), return_inverse=True)
            c = np.bincount(index, weights=times, minlength=len(place)).astype(np.int64).tolist()
            d = np.bincount(index, minlength=len(place)).tolist()
            of = list(groups)
            for group, term, x, y in zip((place // max(n, 1)).tolist(), (place % max(n, 1)).tolist(), c, d):
                terms = seen.setdefault(of[group], {})
                word = words.distinct[term]
                if word in terms:
                    terms[word][0] += x
                    terms[word][1] += y
                else:
                    terms[word] = [x, y]
                    held += 1
            if held > hold:
                yield rows()
                seen, held = {}, 0
        if held:
            yield rows()

    return docs.mapInArrow(run, "lang string, source string, term string, c bigint, d bigint")


def share(c: Column, n: Column, v: Column) -> Column:
    """1 + floor(10**9 (c + 2) / (n + 2 v)) without leaving 64 bits."""
    below = n + ADDED * v
    step = lambda value, rest: (value * 1000 + F.call_function("div", rest * 1000, below), (rest * 1000) % below)
    value, rest = F.call_function("div", c + ADDED, below), (c + ADDED) % below
    for _ in range(3):
        value, rest = step(value, rest)
    return value + 1


def partial_divergences(cell: pa.Table) -> pa.Table:
    """Sums over a cell's terms for each pair of its groups, one of each side.

    Rows without a term are the groups of the cell: their share of a term they lack, and how many terms the block has.
    """
    g, p = cell.column("g").to_numpy(), cell.column("p").to_numpy()
    side, slot = cell.column("side").to_numpy(), cell.column("slot").to_numpy()
    head = slot < 0
    n_terms = int(cell.column("terms").to_numpy()[head].max(initial=0))
    tables, names = [], []
    for s in (0, 1):
        at = np.flatnonzero(head & (side == s))
        at = at[np.argsort(g[at])]
        table = np.repeat(p[at][:, None], n_terms, axis=1)
        rows = np.flatnonzero(~head & (side == s))
        table[np.searchsorted(g[at], g[rows]), slot[rows]] = p[rows]
        tables.append(table)
        names.append(g[at])
    same = bool(cell.column("same")[0].as_py())
    first, second, value = [], [], []
    for i, a in enumerate(tables[0]):
        others = tables[1][i + 1 :] if same else tables[1]
        first.append(np.full(len(others), names[0][i]))
        second.append(names[1][i + 1 :] if same else names[1])
        value.append(((a - others) ** 2 // (a + others)).sum(axis=1))
    join = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
    return pa.table(
        {"lang": pa.array([cell.column("lang")[0].as_py()] * sum(map(len, first)), pa.string()), "a": join(first),
         "b": join(second), "value": join(value)}
    )


class Counts:
    """Kept terms with their counts, the groups and the languages, as tables in the shared folder."""

    def __init__(self, docs: DataFrame, text: str, lang: str, source: str, least_docs: int):
        plain = docs.select(*(as_text(c).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
        groups = written(plain.select("lang", "source").groupBy("lang", "source").count(), "groups")
        n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
        dealt = term_counts(plain).repartition(int(n), "lang", "term")
        summed = dealt.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
        of_term = Window.partitionBy("lang", "term")
        counts = (
            summed.withColumn("docs", F.sum("d").over(of_term))
            .where(F.col("docs") >= least_docs)
            .select("lang", "source", "term", "c", F.sum("c").over(of_term).alias("whole"))
        )
        #: (lang, source, term, c, whole): occurrences in the source and in the language
        self.counts = written(counts, "kept-terms")
        per_source = self.counts.groupBy("lang", "source").agg(F.sum("c").alias("n"))
        per_lang = self.counts.groupBy("lang").agg(F.sum("c").alias("whole_n"), F.countDistinct("term").alias("v"))
        zero = lambda name: F.coalesce(name, F.lit(0).cast("bigint")).alias(name)
        # sources of a language are numbered from 0
        numbered = groups.select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint").alias("g"))
        numbered = numbered.join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left")
        #: (lang, source, g, n, whole_n, v): one row for each group
        self.groups = written(numbered.select("lang", "source", "g", zero("n"), zero("whole_n"), zero("v")), "sources")


def pair_divergences(counts: Counts, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """Rows (lang, a, b, value), a < b numbers of sources of the language."""
    blocks = F.greatest(F.ceil(F.col("v") / term_block), F.lit(1)).cast("int")
    groups = counts.groups.withColumn("blocks", blocks).withColumn("gb", F.expr(f"g DIV {group_block}"))
    most = groups.groupBy("lang").agg(F.max("gb").alias("last"))
    groups = groups.join(most, "lang")
    hashed = F.pmod(F.xxhash64("term"), F.col("blocks"))
    terms = counts.counts.join(groups, ["lang", "source"]).withColumn("tb", hashed)
    in_block = Window.partitionBy("lang", "tb").orderBy("term")
    rows = terms.select(
        "lang", "tb", "g", "gb", "last", share(F.col("c"), F.col("n"), F.col("v")).alias("p"),
        (F.dense_rank().over(in_block) - 1).alias("slot"),
    )
    rows = written(rows, "slices")
    sizes = rows.groupBy("lang", "tb").agg((F.max("slot") + 1).alias("terms"))
    lacking = F.when(F.col("v") > 0, share(F.lit(0).cast("bigint"), F.col("n"), F.col("v"))).otherwise(F.lit(1))
    heads = groups.withColumn("tb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - F.lit(1).cast("bigint"))))
    heads = heads.join(sizes, ["lang", "tb"], "left").select(
        "lang", "tb", "g", "gb", "last", lacking.cast("bigint").alias("p"), F.lit(-1).alias("slot"),
        F.coalesce("terms", F.lit(0)).alias("terms"),
    )
    slices_ = rows.withColumn("terms", F.lit(0)).unionByName(heads)
    # a slice is the first side of the cells to its right and the second of those above it
    zero = F.lit(0).cast("bigint")
    right = slices_.select("*", F.lit(0).alias("side"), F.explode(F.sequence("gb", "last")).alias("other"))
    above = slices_.select("*", F.lit(1).alias("side"), F.explode(F.sequence(zero, F.col("gb"))).alias("other"))
    one, two = F.col("gb"), F.col("other")
    cells = right.withColumns({"i": one, "j": two}).unionByName(above.withColumns({"i": two, "j": one}))
    cells = cells.withColumn("same", F.col("i") == F.col("j"))
    partial = (
        cells.select("lang", "i", "j", "tb", "side", "g", "slot", "p", "terms", "same")
        .groupBy("lang", "i", "j", "tb")
        .applyInArrow(partial_divergences, "lang string, a bigint, b bigint, value bigint")
    )
    return partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergences(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS,
    top_terms: int = TOP_TERMS, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part ``pair``: the divergence from each other source of the language. Part ``term``: the ``top_terms`` kept terms with
    the largest contributions among those that the group has more often than its language. Ranks are by value,
    then by item.
    """
    counts = Counts(docs, text, lang, source, least_docs)
    pairs = written(pair_divergences(counts, group_block, term_block), "pairs")
    both = pairs.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value").select("lang", "x.a", "x.b", "value")
    names = counts.groups.select("lang", "source", "g")
    named = both.join(names.withColumnRenamed("g", "a"), ["lang", "a"]).join(
        names.select("lang", F.col("source").alias("item"), F.col("g").alias("b")), ["lang", "b"]
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pair_rows = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)

    terms = counts.counts.join(counts.groups.drop("g"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share(F.col("c"), F.col("n"), F.col("v")).alias("p"),
        share(F.col("whole"), F.col("whole_n"), F.col("v")).alias("q"),
    ).where("p > q").selectExpr("lang", "source", "item", "((p - q) * (p - q)) DIV (p + q) AS value")
    first = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank)
    return pair_rows.unionByName(first.where(F.col("rank") <= top_terms))


#: DuckDB SQL for the rows of ``divergences`` with its defaults over ``documents``.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
counted AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, c,
         CAST(1 + (1000000000 * (CAST(c AS HUGEINT) + 2)) // (CAST(sum(c) OVER g AS HUGEINT) + 2 * count(*) OVER g) AS BIGINT) AS p
  FROM every WINDOW g AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, sum(c) AS c FROM counted GROUP BY ALL),
whole_shares AS (
  SELECT lang, term,
         CAST(1 + (1000000000 * (CAST(c AS HUGEINT) + 2)) // (CAST(sum(c) OVER g AS HUGEINT) + 2 * count(*) OVER g) AS BIGINT) AS q
  FROM whole WINDOW g AS (PARTITION BY lang)),
divergent AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN divergent d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
  FROM shares JOIN whole_shares USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
