"""Distributed union-find over edges, with DataFrame operations only.

Alternating large-star and small-star steps turn any forest of links into stars whose centre is the smallest id of each
component. A step hooks each id's neighbours to the smallest of them; all ids of a component shrink towards its minimum,
in a number of rounds that grows with the logarithm of its size. Each round is a written table in the shared folder, so
lineage stays short and lost executors cost one round at most. An id that very many links share is only ever
grouped by a partial aggregate (its smallest neighbour) and by joins that AQE splits, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import remove, written


def _hooked(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """One star step over pairs (u, v), u > v. Large star: larger neighbours hook to the smallest neighbour or the id
    itself. Small star: the id and its smaller neighbours hook to the smallest of them."""
    if larger_only:
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        out = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, root) for every id that occurs in edges: root is the smallest id of its component. Nulls and loops are ignored."""
    high: Column = F.greatest(a, b)
    low: Column = F.least(a, b)
    pairs = written(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(high.alias("u"), low.alias("v")).filter("u > v").distinct(), "links")
    for _ in range(most_rounds):
        after = written(_hooked(_hooked(pairs, True), False), "links")
        # Done when nothing that is a child has children of its own and no child has two parents.
        checked = after.select(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionAll(after.select(F.col("v").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        unsettled = checked.groupBy("id").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter("c > 1 or (c > 0 and p > 0)")
        settled = not unsettled.take(1)
        remove(pairs)
        pairs = after
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(roots)
