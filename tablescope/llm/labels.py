"""A bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import as_text, written


def labelled(
    docs: DataFrame, labels: DataFrame, key: str, text: str, targets: dict[str, Column], sample_rows: int
) -> DataFrame:
    """About ``sample_rows`` labelled documents, once each: (id, text, targets as doubles).

    ``targets`` are aggregates of the labels of one key; keys with a NULL among them are left out. The sample follows a
    hash of the key, so it is the same in every run; its keys are few enough for each task.
    """
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id"))
    known = known.agg(*(c.cast("double").alias(n) for n, c in targets.items())).dropna()
    share = min(1.0, sample_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(round(share * 1_000_003)))
    found = docs.select(F.col(key).alias("id"), as_text(text).alias("text")).join(F.broadcast(chosen), "id")
    once = found.groupBy("id").agg(F.min("text").alias("text"), *(F.max(n).alias(n) for n in targets))
    return written(once, "labelled")
