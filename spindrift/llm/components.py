"""Connected components of a link table, distributed: alternating large-star and small-star rounds.

A round needs the least neighbour of every node (pre-aggregated before the shuffle) and one plain join, whose hot
nodes Spark can split. Rounds grow with the logarithm of the longest path. Each round is written to the shared
folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import discard, materialize


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs to (node, root): root is the least node reachable. Nodes without links, and roots, aren't listed."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = materialize(links)
    state = _state(links)
    while state[0]:
        both = links.union(links.select("b", "a")).toDF("u", "v")
        near = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.join(near, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(least, "a")
        small = joined.select("b", "m").where("b <> m").toDF("a", "b").union(least.toDF("a", "b"))
        last, links = (links, near, large, least), materialize(small.distinct())
        discard(*last)
        before, state = state, _state(links)
        if before == state:
            break
    return links.toDF("node", "root")
