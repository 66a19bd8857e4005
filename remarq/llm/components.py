"""Connected components of an edge list, by rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Rounds after which something must be wrong: components settle in a number of rounds that grows with the logarithm of their size.
MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node with an edge; label is the smallest node of its component.

    Each half round replaces neighbours by links to the smallest one, and each is an aggregation to a
    minimum (pre-aggregated before its shuffle) and an equi-join, so no task holds a node's
    neighbours. Every round is written to the shared folder, in the place of the one before. Null ends and loops are ignored.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    links = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        # large star: every neighbour above a node links to the smallest of the node and its neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lower neighbours link to the smallest of these; all links point down here
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        links = stored(moved.where("u != v").distinct(), "links", instead_of=links)
        now = links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(links.select("v", "v").distinct())
