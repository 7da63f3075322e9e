"""How a column of the input table is read: typing, missing cells, level text."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)

#: text of a missing level in a categorical column
MISSING_LEVEL = "nan"


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_whole(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), WHOLE_TYPES)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), WHOLE_TYPES + REAL_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    """Integer, floating and decimal columns, in table order. Booleans are not numbers here."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, WHOLE_TYPES + REAL_TYPES)]


def pick_numeric(df: DataFrame, names: Sequence[str] | None) -> list[str]:
    """The requested numeric columns, or all of them."""
    if names is None:
        return numeric_columns(df)
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"columns not in the table: {absent}")
    wrong = [n for n in names if not is_numeric(df, n)]
    if wrong:
        raise ValueError(f"columns are not numeric: {wrong}")
    return list(names)


def measure(df: DataFrame, name: str) -> Column:
    """The column as a double; NULL, NaN and infinities are all NULL, -0.0 is 0.0.

    NaN sorts above every number in Spark, so one comparison rejects NaN and +-inf.
    """
    if is_whole(df, name):
        return col(name).cast("double")
    value = col(name).cast("double") + F.lit(0.0)
    return F.when(F.abs(value) < F.lit(math.inf), value)


def cell(df: DataFrame, name: str) -> Column:
    """The column in its own type with NaN and infinities turned into NULL."""
    if isinstance(data_type(df, name), (T.FloatType, T.DoubleType)):
        return F.when(F.abs(col(name)) < F.lit(math.inf), col(name))
    return col(name)


def filled(df: DataFrame, name: str, value: float = 0.0) -> Column:
    return F.coalesce(measure(df, name), F.lit(float(value)))


def level_text(df: DataFrame, name: str) -> Column:
    """Text of a categorical level; a missing cell is the level ``nan``.

    Doubles print with a plain integral part up to 1e16 (Spark alone switches to ``1.0E7`` notation).
    """
    kind = data_type(df, name)
    text = col(name).cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = col(name).cast("double")
        plain = (F.abs(value) < F.lit(1e16)) & (value == F.floor(value).cast("double"))
        text = (
            F.when(F.isnan(value), F.lit(MISSING_LEVEL))
            .when(plain, F.concat(F.expr(f"try_cast({_quoted(name)} as bigint)").cast("string"), F.lit(".0")))
            .otherwise(text)
        )
    elif isinstance(kind, T.BooleanType):
        text = F.initcap(text)
    return F.coalesce(text, F.lit(MISSING_LEVEL))


def text_hash(text: Column, seed: int) -> Column:
    """64 bits that stand for a text; whoever uses them looks for a ``seed`` with which the texts at hand do not collide."""
    return F.xxhash64(F.lit(seed), text)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def double_array(values: Iterable[float]) -> Column:
    """A constant ``array<double>``, folded once by Catalyst from a single literal."""
    text = ",".join(repr(float(v)) for v in values)
    return F.split(F.lit(text), ",").cast("array<double>")


def at(array: Column, index: Column) -> Column:
    """0-based element of an array known to be long enough."""
    return F.get(array, index)


def require_rows(df: DataFrame) -> DataFrame:
    """Reject a table without columns or rows."""
    if not df.columns or df.isEmpty():
        raise ValueError("the table is empty")
    return df
