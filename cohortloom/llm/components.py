"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.staging import discard, stage


def _nearest(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with the smallest v of its u; sums up before the shuffle, crowded u can be split by the join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of all nodes in ``links`` (a, b); nodes without links do not occur.

    Alternates two steps until nothing changes: larger neighbours move to the smallest neighbour, then smaller ones do.
    The number of rounds grows with the logarithm of the longest path. Each state is a table in the shared folder;
    the last one is deleted when the next is there. Nulls and links of a node with itself do not count.
    """
    u, v = F.greatest("a", "b"), F.least("a", "b")
    state = stage(links.where("a <> b").select(u.alias("u"), v.alias("v")).distinct(), "links")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    now = mark(state)
    while now["n"]:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        near = _nearest(large)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        after = stage(small.distinct(), "links")
        then = mark(after)
        discard(state)
        state = after
        if then == now:
            break
        now = then
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
