"""Draws and orders from md5, so that they are the same on any number of partitions and in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(parts) -> list[Column]:
    return [F.lit(str(p)) if not isinstance(p, Column) else p.cast("string") for p in parts]


def stable_key(*parts) -> Column:
    """md5 of the parts, joined by a bar."""
    return F.md5(F.concat_ws("|", *_text(parts)))


def draw(n, *parts) -> Column:
    """A number from 0 to n - 1."""
    return F.pmod(F.conv(F.substring(stable_key(*parts), 1, 8), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def uniform(*parts) -> Column:
    """A number in [0, 1)."""
    return F.conv(F.substring(stable_key(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
