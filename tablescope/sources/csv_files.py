"""CSV files with detected separator and pandas-like typing, and CSV output."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.columns import col

SEPARATORS = (",", ";", "\t", "|")

# fixed values: cell texts that mean "missing"
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

REAL_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITE_TEXTS = ("inf", "+inf", "-inf", "Infinity", "+Infinity", "-Infinity")
BOOLEAN_TEXTS = ("True", "False", "TRUE", "FALSE", "true", "false")

#: what the cells of a column look like, as bits: masks of parts of a file combine by "or"
WHOLE, REAL, BOOLEAN, TEXT = 1, 2, 4, 8

#: takes what a row has beyond the header's fields
_SURPLUS = "__surplus_field"


def detect_separator(lines: Sequence[str]) -> str:
    """The separator that splits the first lines into the same number of fields; the most fields win."""
    lines = [line for line in lines if line.strip()]
    best, best_fields = ",", 1
    for separator in SEPARATORS:
        counts = [_outside_quotes(line).count(separator) + 1 for line in lines]
        if counts and counts[0] > best_fields and min(counts) == max(counts):
            best, best_fields = separator, counts[0]
    if best_fields == 1 and lines:  # ragged file: trust the header line
        header = _outside_quotes(lines[0])
        best = max(SEPARATORS, key=header.count)
    return best


def _outside_quotes(line: str) -> str:
    return re.sub(r'"[^"]*"', "", line)


def location_label(location: str) -> str:
    """Last segment of a path or URI."""
    return location.rstrip("/").split("/")[-1]


def read_csv(
    spark: SparkSession,
    location: str,
    separator: str | None = None,
    schema: T.StructType | str | None = None,
    multiline: bool = False,
    sniff_lines: int = 20,
) -> DataFrame:
    """Read CSV from any location Spark can open (``file:``, ``hdfs:``, ``s3a:``, …), with a header row.

    Without ``schema`` one scan decides each column's type (bigint, double, boolean or string), treating the
    usual texts for missing values as NULL; later scans parse only the columns they ask for. Give a schema for very
    large files to save that scan: it names every column of the file, in the file's order or by the file's names.
    ``multiline`` allows line breaks inside quotes, at the price of one task per file. Without ``separator`` the first
    ``sniff_lines`` lines decide it.

    A row with fewer fields than the header has NULL in the others. A row with a further field that holds something
    fails the scan for types, or with a schema the job that reads it, so that nothing is lost unseen.
    """
    if separator is None:
        first = spark.read.text(location).limit(sniff_lines).collect()
        if not first:
            raise ValueError(f"{location} is empty")
        separator = detect_separator([r[0] for r in first])
    reader = (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
    )
    names = reader.option("inferSchema", False).csv(location).columns
    plain = T.StructType([T.StructField(c, T.StringType()) for c in names])
    texts = reader.schema(T.StructType([*plain.fields, T.StructField(_SURPLUS, T.StringType())])).csv(location)
    excess = f"{location_label(location)} has a row with more than {len(names)} fields, such as "
    if schema is not None:
        wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if len(wanted.fields) != len(names):
            raise ValueError(f"the schema names {len(wanted.fields)} columns {wanted.names}, the file has {names}")
        by_name = set(wanted.names) == set(names)
        sources = wanted.names if by_name else names
        # the filter looks at the surplus whichever columns are asked for
        refuse = F.raise_error(F.concat(F.lit(excess), F.col(_SURPLUS))).cast("boolean")
        return texts.where(F.when(F.col(_SURPLUS).isNull(), F.lit(True)).otherwise(refuse)).select(
            *[_typed(c, f.dataType.simpleString()).alias(f.name) for c, f in zip(sources, wanted.fields, strict=True)]
        )
    kinds = infer_types(texts)
    if (found := kinds.pop(_SURPLUS)) is not None:
        raise ValueError(excess + found)
    return reader.schema(plain).csv(location).select(*[_typed(c, kinds[c]).alias(c) for c in names])


def _present(name: str) -> Column:
    text = F.trim(col(name))
    return F.when(~text.isin(*MISSING_TEXTS), text)


def _typed(name: str, kind: str) -> Column:
    if kind == "string":
        return F.when(~col(name).isin(*MISSING_TEXTS), col(name))
    return _present(name).try_cast(kind)


def infer_types(texts: DataFrame) -> dict[str, str | None]:
    """Narrowest type that holds every cell of a text column: bigint, double, boolean, else string.

    One scan; each task keeps one mask a column. The surplus column's entry is one of its cells, or None if there is none.
    """
    names = [c for c in texts.columns if c != _SURPLUS]
    cells = texts.select(*[_present(c).alias(f"c_{i}") for i, c in enumerate(names)], col(_SURPLUS))
    # a projection of its own: inside the aggregate each look would be taken twice
    looks = cells.select(*[_look(F.col(f"c_{i}")).alias(f"c_{i}") for i in range(len(names))], _SURPLUS)
    row = looks.agg(
        *[F.bit_or(f"c_{i}").alias(f"c_{i}") for i in range(len(names))], F.max(_SURPLUS).alias(_SURPLUS)
    ).first()
    return {c: _narrowest(row[f"c_{i}"] or 0) for i, c in enumerate(names)} | {_SURPLUS: row[_SURPLUS]}


def _look(cell: Column) -> Column:
    # a pattern, since a failing cast is slow and Spark would also read "1d" as a number; 18 digits always fit 64 bits
    fraction = cell.contains(".") | cell.contains("e") | cell.contains("E")
    whole = ~fraction & ((F.length(cell) <= 18) | cell.try_cast("bigint").isNotNull())
    return (
        F.when(cell.isNull(), F.lit(0))
        .when(cell.rlike(REAL_PATTERN), F.when(whole, F.lit(WHOLE)).otherwise(F.lit(REAL)))
        .when(cell.isin(*INFINITE_TEXTS), F.lit(REAL))
        .when(cell.isin(*BOOLEAN_TEXTS), F.lit(BOOLEAN))
        .otherwise(F.lit(TEXT))
    )


def _narrowest(mask: int) -> str:
    if mask == WHOLE:
        return "bigint"
    if mask | REAL | WHOLE == REAL | WHOLE:  # also a column without any cell
        return "double"
    return "boolean" if mask == BOOLEAN else "string"


def write_csv(df: DataFrame, location: str, separator: str = ",", mode: str = "errorifexists") -> None:
    """Write with a header row; one file per partition."""
    df.write.mode(mode).option("header", True).option("sep", separator).option("escape", '"').csv(location)
