"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.storage import materialise

#: Rounds end by themselves when nothing changes; this only stops a run that could not end.
MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each node's component, for all nodes with an edge.

    ``edges`` has two columns ``a, b`` of one ordered type. Large-star and small-star
    steps alternate (each a grouping by node with a minimum, so hot nodes are
    combined on the map side) until the edges are stars; the number of rounds grows
    with the logarithm of the longest path. Self links and repeats do no harm.
    """
    stars = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _summary(stars)
    for _ in range(MAX_ROUNDS):
        stars = materialise(_small_star(_large_star(stars)), "stars")
        after = _summary(stars)
        if before == after:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = after
    raise RuntimeError("the components did not settle")


def _summary(edges: DataFrame) -> tuple:
    """A checksum of an edge set, without repeats."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(lowest, "a")
    return (
        moved.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(lowest.select("a", F.col("low").alias("b"))).distinct()
    )
