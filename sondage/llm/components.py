"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.session import Rounds


def _lowest(edges: DataFrame, hub: str) -> DataFrame:
    """(u, m): the smallest of a node and its neighbours."""
    return edges.groupBy(hub).agg(F.min("v").alias("m")).select(F.col(hub).alias("u"), F.least("m", hub).alias("m"))


def _stars(e: DataFrame) -> DataFrame:
    """The edges (u, v), v the smaller, after a large and a small star."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_lowest(both, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return small.where("u != v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): every node that has an edge, with the smallest node that it reaches.

    ``edges`` has two columns of one orderable type; loops and repeats are harmless, null ends are left out.
    A hub is never gathered in one task: its minimum is a partial aggregation, and its edges are
    an equality join, which adaptive execution splits. Each round is cut by a checkpoint, of which the last two stay.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    rounds = Rounds(e.sparkSession)
    e, last = rounds.hand_on(e.distinct()), None
    while True:
        with rounds.round():
            e = rounds.hand_on(_stars(e))
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    # when nothing changes any more each edge leads from a node to its root
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
