"""Connected components by alternating large-star and small-star, all as grouped aggregations and joins.

Hubs with more than FREQUENT of all edges, of which there are at most 2 / FREQUENT, meet their edges by broadcast, so no task gets all
edges of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import looked_up, written

FREQUENT = 1e-3


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node is a centre or has one edge to a centre."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a > 1 or (a = 1 and b > 0)").limit(1).count() == 0


def _frequent(edges: DataFrame) -> float:
    return max(1.0, edges.count() * FREQUENT)


def large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of itself and its neighbours."""
    frequent = _frequent(edges)
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return looked_up(both.where("v > u"), least, ["u"], "n", frequent).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them; edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    linked = looked_up(edges, least, ["u"], "n", _frequent(edges)).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def stars(edges: DataFrame, name: str = "stars") -> DataFrame:
    """Edges (u, v), each node that isn't its component's least once as u with that least as v.

    edges: (u, v) of any comparable type, no nulls; loops and repeats do no harm. No edges give no stars.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while not _is_stars(now):
        now = written(small_star(written(large_star(now), name)), name)
    return now
