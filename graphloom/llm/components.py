"""Connected components of a link table by alternating large and small stars.

Each round replaces every node's links by links to the smallest node around it;
the number of rounds grows with the logarithm of the longest path. Nothing is
collected but two sums a round. Rounds are cut by stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import dropped, stored


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(links: DataFrame, label: str = "links", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``links`` (columns a and b, long): root is the smallest node it can reach.

    Links may repeat and may join a node to itself; null ends are left out; an
    empty table gives no rows. Nodes that are a root themselves are included.
    """
    pair = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    stars = stored(pair.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    told = None
    for _ in range(most_rounds):
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(small, "u")
        before, stars = stars, stored(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), label
        )
        dropped(before)
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == told:
            break
        told = now
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
