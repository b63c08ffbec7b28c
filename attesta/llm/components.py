"""Connected components of a link table by repeated contraction, all in joins and partial minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of ``links``: root is the smallest node of its component.

    Each round maps a node to the smallest of its neighbours and itself, then to that one's own choice, and
    contracts the links; at least half of the nodes vanish in a round. Nulls and self links are dropped; an
    empty table gives no rows. A hub is one row after the partial minimum, so no key is gathered in a task.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    edges = written(edges, "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        first = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("p"))
        first = written(first, "parents")
        step = first.alias("x").join(first.alias("y"), F.col("x.p") == F.col("y.node")).select(F.col("x.node"), F.col("y.p").alias("root"))
        step = written(step, "round")
        rounds.append(step)
        ends = edges.join(step.toDF("a", "ra"), "a").join(step.toDF("b", "rb"), "b")
        edges = written(ends.filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col(a).alias("node"), F.col(a).alias("root")).limit(0)
    out = rounds[0]
    for step in rounds[1:]:
        later = step.toDF("root", "next")
        out = out.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
