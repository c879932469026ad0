"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregates with map-side minima and two joins; neither star
makes more edges than it gets, so equal ones are folded once a round.  Rounds
grow with the logarithm of the longest path.  Nothing is gathered on the driver but
a count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.withColumnRenamed("m", "b"))


def _stars(edges: DataFrame) -> bool:
    """Whether each node either hangs on one least node or is one; one aggregate with map-side counts."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("least")).unionByName(
        edges.select(F.col("b").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("least"))
    )
    roles = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("least").alias("least"))
    return roles.where("hangs > 1 or (hangs > 0 and least > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each node of edges (a, b) the least node it is joined to.

    Nodes without an edge to another are left out; null ends are ignored.
    """
    ordered = edges.where("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    work, k = Scratch(edges.sparkSession, "components"), 0
    now = work.store("0", ordered.distinct())
    while not _stars(now):
        now = work.store(str(k + 1), _small_star(_large_star(now)).distinct())
        work.drop(str(k))
        k += 1
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
