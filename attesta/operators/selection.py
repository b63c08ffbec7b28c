"""Exact order statistics and quantiles of groups of any size.

The rows of a group are counted in ranges between approximate quantiles; the range that holds the wanted rank is looked
into again, until it is a single value or few enough rows to be sorted. A round is a partial aggregation, and the rows
shrink by the number of ranges, so that two or three rounds do for billions and no task holds more than ``SORTED`` values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.ranking import bucket, score_cuts
from attesta.sources.scratch import written

#: Ranges of a group in a round, and rows of a range that are sorted.
RANGES, SORTED = 256, 1 << 16


def _met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Joined on keys that may be null."""
    if not keys:
        return a.withColumn("_one", F.lit(1)).join(F.broadcast(b.withColumn("_one", F.lit(1))), "_one").drop("_one")  # one group: few rows
    named = b.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    return a.join(named, on).drop(*[f"_b_{k}" for k in keys])


def order_statistics(df: DataFrame, group: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """(group, _j, _v): the value of rank ``_k`` (from 0, ascending) for each row (group, _j, _k) of ``wanted``.

    Null values don't count, NaN is largest; ranks that a group doesn't have give no rows.
    """
    values = df.select(*group, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    keys, found = list(group), []
    while True:
        cuts = score_cuts(values, keys, "_v", RANGES)
        # a cut is a range of its own, so that a round that finds one value everywhere parts it from the rest
        place = bucket("_cuts", F.col("_v"))
        placed = _met(values, cuts, keys).withColumn("_r", 2 * place + F.coalesce(F.get("_cuts", place) == F.col("_v"), F.lit(False)).cast("int"))
        placed = written(placed.select(*values.columns, "_r"), "placed")
        ranges = placed.groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_r")) - F.col("_n")  # 2 * RANGES rows a group
        hit = _met(wanted, ranges.withColumn("_before", before), keys).filter("_k >= _before and _k < _before + _n")
        hit = written(hit.withColumn("_k", F.col("_k") - F.col("_before")), "ranks")
        one, few = F.col("_low") == F.col("_high"), F.col("_n") <= SORTED
        found.append(hit.filter(one).select(*group, "_j", F.col("_low").alias("_v")))
        small = hit.filter(~one & few)
        sorted_ = _met(placed, small.select(*keys, "_r").distinct(), [*keys, "_r"]).groupBy(*keys, "_r").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        found.append(_met(small, sorted_, [*keys, "_r"]).select(*group, "_j", F.get("_all", F.col("_k").cast("int")).alias("_v")))
        open_ = hit.filter(~one & ~few)
        if open_.isEmpty():
            break
        inside = f"_in{len(keys)}"
        values = _met(placed, open_.select(*keys, "_r").distinct(), [*keys, "_r"]).select(*keys, F.col("_r").alias(inside), "_v")
        wanted = open_.select(*keys, F.col("_r").alias(inside), "_j", "_k")
        keys = [*keys, inside]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def quantiles(df: DataFrame, group: list[str], value: str, at: list[float], into: str = "quantiles") -> DataFrame:
    """(group, ``into``): the linearly interpolated quantiles ``at`` of the known values, an array in that order.

    Groups without a known value give no row; without ``group`` the whole table is one.
    """
    spot = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("_c") - 1) * F.lit(float(q))).alias("at")) for i, q in enumerate(at)]))
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 0")
    spots = written(sizes.select(*group, spot.alias("s")).select(*group, F.col("s.i").alias("_i"), F.col("s.at").alias("_at")), "spots")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("_at").alias("k")), F.struct(F.lit(1).alias("side"), F.ceil("_at").alias("k"))))
    wanted = spots.select(*group, "_i", ends.alias("e")).select(*group, (2 * F.col("_i") + F.col("e.side")).alias("_j"), F.col("e.k").alias("_k"))
    stats = order_statistics(df, group, value, wanted).withColumn("_i", F.floor(F.col("_j") / 2).cast("int"))
    pair = stats.groupBy(*group, "_i").agg(F.max(F.when(F.col("_j") % 2 == 0, F.col("_v"))).alias("_lo"), F.max(F.when(F.col("_j") % 2 == 1, F.col("_v"))).alias("_hi"))
    share = F.col("_at") - F.floor("_at")
    worth = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((1 - share) * F.col("_lo") + share * F.col("_hi"))
    each = _met(spots, pair, [*group, "_i"]).select(*group, F.struct("_i", worth.alias("v")).alias("s"))
    return each.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["v"]).alias(into))
