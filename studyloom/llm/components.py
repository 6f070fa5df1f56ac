"""Connected components of a graph too large for one machine: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, durable

#: Tasks that share the edges of a node.
SALTS = 8


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that hangs on none itself, so that no round is left to do."""
    side = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"))))
    nodes = edges.select(side.alias("x")).groupBy("x.node").agg(F.sum("x.up").alias("up"), F.min("x.up").alias("least"))
    return not nodes.where("up > 1 or up = 1 and least = 0").agg(F.count("*")).first()[0]


def _hooked(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge with what ``least`` says of its node a, as m. The edges of a node are dealt over ``SALTS`` tasks, and adaptive
    execution may split those further, so a hub never meets its neighbours in one task."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    copies = least.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return salted.join(copies, ["a", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of edges (a, b: of one type that has an order). Each round hooks
    nodes to smaller neighbours by one aggregation and one join a star. Rounds end when every node hangs directly on its
    smallest, after about log(n)**2 at worst; what a round wrote goes when the next one is written."""
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(now):
        ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        both = now.select(ways.alias("x")).select("x.a", "x.b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _hooked(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        again = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _hooked(large, again).where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        after = durable(small.unionByName(again.select("a", F.col("m").alias("b"))).distinct())
        dropped(now)
        now = after
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
