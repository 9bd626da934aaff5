"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, drop


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _settled(edges: DataFrame) -> bool:
    """Whether every u has one edge and no v is a u."""
    if edges.groupBy("u").agg(F.count("*").alias("k")).where("k > 1").limit(1).count():
        return False
    return not edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every u that isn't the smallest of its component; edges has columns u and v.

    Alternates large-star and small-star steps until every edge leads from a node to its root. No step
    forms pairs of a node's neighbours: each edge is replaced by one or two. Loops and repeated edges
    don't matter; edges with a null end are ignored; without edges the result is empty.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(now):
        # large star: a node's larger neighbours go to the smallest of the node and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        was, now = now, cut(large.join(_least(large), "u").select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct())
        drop(was)
    return now.select("u", F.col("v").alias("root"))
