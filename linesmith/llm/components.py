"""Connected components of a graph of long ids, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """u, root for every node with a link, where root is the smallest node of its component; roots themselves are not listed.

    edges has the columns a and b. Each step is an aggregation (with partial minima before the shuffle) and a join on the
    aggregated key, which has one row per node on that side, so the links of a hub can be split over tasks.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    scratch = Scratch(edges.sparkSession)
    e = scratch.stored(e)
    before = _state(e)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.stored(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        scratch.drop(e, large)
        e, after = now, _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return e.select("u", F.col("v").alias("root"))
