"""Small column helpers used throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mapped(values: dict, key: Column) -> Column:
    """The value of a small fixed map, null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def each_of(df: DataFrame, values: list, name: str) -> DataFrame:
    """Every row once for each of a few fixed values, in one scan."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def ratio(a, b) -> Column:
    """a / b as a double; null where b is 0 or null."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def no_nan(c) -> Column:
    return F.nullif(col(c).cast("double"), F.lit(float("nan")))


def is_true(c) -> Column:
    """Text or boolean truth; anything else is false."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("1", "1.0", "true", "correct", "yes"), F.lit(False))
