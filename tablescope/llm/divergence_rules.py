"""Quality rules on how far a text's histograms lie from those of its language, as DataFrame expressions only.

Two histograms of each document are compared to a reference: the classes of its characters, and its words among the
common words of its language, with one bin for all other words. The reference of a language is the histogram of all
its documents together. The distance is that of Jensen and Shannon: the square root of the divergence in bits, between
0 (equal) and 1 (nothing in common).

Short texts have ragged histograms, so guards apply: characters are compared from ``least_chars`` on, words from
``least_words`` on; below that a test passes. Languages without a word list here, and NULL, form the group ``other``,
whose words are not compared.

Repeated word windows are found by sorting each text's windows, so long texts cost n log n. NULL texts count as empty:
no words, and so base_failed. Repeated rows are judged each. Other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import SPACE_CLASS, WORD_CLASS, as_text, written

# fixed values: common words by language
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they "
    "which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er "
    "hat dass sie nach",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son "
    "lui",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
}
OTHER = "other"
#: what words may carry around them
AROUND = r"[.,;:!?\"'()]*+"
BLANKS = "".join(map(chr, (32, *range(9, 14))))
CLASSES = ("lower", "upper", "digit", "blank", "symbol", "rest")

LEAST_WORDS = 50
LEAST_CHARS, LEAST_COMPARED = 200, 100
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.22, 0.33


def common_words() -> Column:
    """The word list of the row's ``language``; empty for ``other``."""
    lists = [F.when(F.col("language") == n, F.array(*map(F.lit, w.split()))) for n, w in COMMON.items()]
    return F.coalesce(*lists, F.array().cast("array<string>"))


def word_pattern(words: str) -> str:
    """Finds these words in lower-cased text that begins and ends with a blank, whatever ``AROUND`` allows beside them."""
    by_first = groupby(sorted(words.split()), key=lambda w: w[0])
    known = "|".join(a + "(?:" + "|".join(re.escape(w[1:]) for w in rest) + ")" for a, rest in by_first)
    return f"{SPACE_CLASS}{AROUND}({known}){AROUND}(?={SPACE_CLASS})"


def common_hits() -> Column:
    """Each occurrence of a common word of the row's ``language`` in its ``text``, in one pass over the text."""
    padded = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    found = [F.when(F.col("language") == n, F.regexp_extract_all(padded, F.lit(word_pattern(w)), 1)) for n, w in COMMON.items()]
    return F.coalesce(*found, F.array().cast("array<string>"))


def text_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row of counts for each document; its text is not among them."""
    known = F.lower(F.col(lang)).isin(*COMMON)
    words = docs.select(
        F.col(key).alias("doc_id"),
        F.when(known, F.lower(F.col(lang))).otherwise(F.lit(OTHER)).alias("language"),
        as_text(text).alias("text"),
    )
    inner = F.btrim("text", F.lit(BLANKS))
    words = words.select(
        "*",
        F.when(inner != "", F.split(inner, f"{SPACE_CLASS}+", -1)).otherwise(F.array().cast("array<string>")).alias("words"),
        common_words().alias("common"),
    )
    # the places of windows whose words occur again: equal neighbours once the windows are sorted
    windows = F.when(
        F.size("words") >= 4,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size("words") - 3),
                # element by element: slice() would copy the whole array for every window
                lambda i: F.struct(
                    F.concat_ws(" ", *(F.get("words", i + k) for k in range(3))).alias("w"), i.alias("i")
                ),
            )
        ),
    ).otherwise(F.expr("CAST(array() AS array<struct<w:string,i:int>>)"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD_CLASS))
    counted = words.select(
        "doc_id", "language", "common", F.size("words").cast("bigint").alias("n_words"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("symbol"),
        # runs of many are fewer matches than single characters
        F.length(F.regexp_replace("text", r"\p{Ll}+", "")).cast("bigint").alias("not_lower"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("bigint").alias("upper"),
        F.regexp_count("text", F.lit(r"\p{Nd}")).cast("bigint").alias("digit"),
        lines.alias("lines"), windows.alias("windows"),
        common_hits().alias("hits"),
    )
    counted = counted.withColumns(
        {"blank": F.col("n_chars") - F.col("word_chars"), "lower": F.col("n_chars") - F.col("not_lower")}
    )
    n = F.size("windows")
    again = F.zip_with(
        F.slice("windows", 1, F.greatest(n - 1, F.lit(0))),
        F.slice("windows", 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])),
    )
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(again, lambda x: x.isNotNull()))))
    placed = counted.select(
        "*",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(n > 1, places).otherwise(F.expr("CAST(array() AS array<int>)")).alias("places"),
        F.transform("common", lambda w: F.size("hits") - F.size(F.array_remove("hits", w))).alias("word_bins"),
        (F.col("n_chars") - F.col("blank") - F.col("symbol") - F.col("lower") - F.col("upper") - F.col("digit"))
        .alias("rest"),
    )
    # each window covers three words, those up to the next window only once
    gaps = F.zip_with(
        "places",
        F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))),
        lambda a, b: F.when(a.isNull(), 0).otherwise(F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
    )
    covered = F.aggregate(gaps, F.lit(0), lambda total, x: total + x)
    return placed.select(
        "doc_id", "language", "n_words", "n_chars", "word_chars",
        F.col("symbol").alias("n_symbols"), "n_dup_lines", covered.cast("bigint").alias("n_repeat_words"),
        F.array(*CLASSES).alias("class_bins"), "word_bins",
    )


def histogram_sums(bins: str, length: int) -> Column:
    """An array of the sums of each place of an array column."""
    return F.array(*(F.coalesce(F.sum(F.get(bins, F.lit(i))), F.lit(0)) for i in range(length)))


def references(counts: DataFrame) -> DataFrame:
    """Histograms of all documents of a language together: as many rows as there are word lists, and ``other``."""
    longest = max(len(w.split()) for w in COMMON.values())
    return counts.groupBy("language").agg(
        histogram_sums("class_bins", len(CLASSES)).alias("class_all"), F.sum("n_chars").alias("chars_all"),
        histogram_sums("word_bins", longest).alias("word_all"), F.sum("n_words").alias("words_all"),
    )


def distance(mine: Column, total: Column, theirs: Column, total_all: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts with the given totals, bin by bin."""
    def half(x: Column, middle: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)

    def bit(a: Column, b: Column) -> Column:
        p = F.coalesce(a / F.greatest(total, F.lit(1)), F.lit(0.0))
        q = F.coalesce(b / F.greatest(total_all, F.lit(1)), F.lit(0.0))
        return (half(p, (p + q) / 2) + half(q, (p + q) / 2)) / 2

    whole = F.aggregate(F.zip_with(mine, theirs, bit), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(whole, F.lit(0.0)))


def with_others(bins: Column, total: Column) -> Column:
    """A histogram with what its bins leave of the total as one bin more."""
    return F.concat(bins, F.array(total - F.aggregate(bins, F.lit(0).cast("bigint"), lambda s, x: s + x)))


def judge(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    most_class: float = MOST_CLASS_DISTANCE, most_words: float = MOST_WORD_DISTANCE,
) -> DataFrame:
    """Counts, both distances, base_failed and kept, one row for each document."""
    counts = written(text_counts(docs, key, text, lang), "text-counts")
    # a row for each word list and one more, whatever the documents are
    known = F.broadcast(references(counts))
    size = F.size("word_bins")
    measured = counts.join(known, "language").select(
        "*",
        distance(F.col("class_bins"), F.col("n_chars"), F.col("class_all"), F.col("chars_all")).alias("class_distance"),
        with_others(F.col("word_bins").cast("array<bigint>"), F.col("n_words")).alias("word_mine"),
        with_others(F.slice("word_all", F.lit(1), size), F.col("words_all")).alias("word_theirs"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    tests = [
        (F.col("n_chars") < LEAST_CHARS) | (F.col("class_distance") <= most_class),
        (F.col("n_words") < LEAST_COMPARED) | (F.col("language") == OTHER) | (F.col("word_distance") <= most_words),
    ]
    return measured.select(
        "*",
        distance(F.col("word_mine"), F.col("n_words"), F.col("word_theirs"), F.col("words_all")).alias("word_distance"),
    ).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & reduce(lambda a, b: a & b, tests)).alias("kept"), "class_distance", "word_distance",
    )
