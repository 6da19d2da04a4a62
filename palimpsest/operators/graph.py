"""Category membership and sub-graphs (GR6-8, JN14 of the survey)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.links import at_layer
from palimpsest.schemas import CATEGORIZATION, SENTINEL_LAYER
from palimpsest.storage import materialise

#: Levels that are walked one by one before chains are looked for; most category trees end within them.
PLAIN_LEVELS = 6
#: Written rounds that are put together into one table, so that plans stay short.
ROUNDS_TOGETHER = 8


def category_members(links: DataFrame, seeds: DataFrame, layer=SENTINEL_LAYER) -> DataFrame:
    """GR6: ``page_id`` of pages that a seed category (``page_id``) has as direct members; a seed may be among them."""
    edges = at_layer(links, layer, (CATEGORIZATION,))
    return edges.join(seeds.select(F.col("page_id").alias("target_id")).distinct(), "target_id", "left_semi").select(F.col("source_id").alias("page_id")).distinct()


def category_closure(links: DataFrame, seeds: DataFrame, layer=SENTINEL_LAYER, plain_levels: int = PLAIN_LEVELS) -> DataFrame:
    """GR7: ``page_id, depth`` of all pages below the seed categories, seeds left out; depth is the least number of steps.

    Breadth first: each level is the last level's members that were not met before, so
    cycles end. A level is written down once, which keeps plans short however deep it goes. What is
    deeper than ``plain_levels`` is walked by ``deep_levels``, in which a chain of any length is one step.
    """
    edges = at_layer(links, layer, (CATEGORIZATION,)).select(F.col("target_id").alias("page_id"), F.col("source_id").alias("member"))
    level = seeds.select("page_id").distinct().withColumn("depth", F.lit(0))
    met = level
    for depth in range(1, plain_levels + 1):
        members = edges.join(level.select("page_id"), "page_id", "left_semi").select(F.col("member").alias("page_id")).distinct()
        level = materialise(members.join(met, "page_id", "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if level.isEmpty():
            return met.where("depth > 0")
        met = met.unionByName(level)
    # All that is met has its least depth; the rest of the graph is what is left without it.
    rest = materialise(edges.distinct().join(met.select(F.col("page_id").alias("member")), "member", "left_anti").join(met.where(F.col("depth") < plain_levels), "page_id", "left_anti"), "closure-rest")
    return met.where("depth > 0").unionByName(deep_levels(rest, level))


def chains(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """``page_id, head, dist``: every page inside a chain, with the page before the chain's first and the steps from it.

    Inside a chain are pages with one page above and one member, but for those in ``ends``. Each points to the page above it;
    in every round a pointer is replaced by that of the page it points to, so lengths double. Cycles of such pages, which nothing
    leads into, have no head; they are what still points inwards when rounds outnumber the digits of their count, and are left out.
    """
    above = edges.groupBy(F.col("member").alias("page_id")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("head")).where("n = 1").drop("n")
    below = edges.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    inner = materialise(above.join(below, "page_id", "left_semi").join(ends.select("page_id"), "page_id", "left_anti"), "chain-pages")
    inside = inner.select(F.col("page_id").alias("head"), F.lit(True).alias("_inside"))
    current = materialise(inner.join(inside, "head", "left").select("page_id", "head", F.lit(1).cast("long").alias("dist"), F.coalesce("_inside", F.lit(False)).alias("open")), "chains")
    for _ in range(inner.count().bit_length() + 1):
        moving = current.where("open")
        if moving.isEmpty():
            break
        onward = current.select(F.col("page_id").alias("head"), F.col("head").alias("_head"), F.col("dist").alias("_dist"), F.col("open").alias("_open"))
        moved = moving.join(onward, "head").select("page_id", F.col("_head").alias("head"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_open").alias("open"))
        current = materialise(current.where("NOT open").unionByName(moved), "chains")
    return current.where("NOT open").drop("open")


def deep_levels(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``page_id, depth`` of what can be reached from ``start`` (``page_id, depth``), which is left out; ``edges`` (``page_id, member``) are distinct.

    Chains are found first, by doubling pointers, and become edges of their length. Then depths are lowered round by round along
    edges that start at pages whose depth was lowered, until none is. Pages inside chains get their depth from their heads.
    """
    inner = chains(edges, start)
    step = edges.join(inner.select(F.col("page_id").alias("member")), "member", "left_anti")
    via = step.join(inner, "page_id", "left")
    short = materialise(via.select(F.coalesce("head", "page_id").alias("page_id"), "member", (F.coalesce("dist", F.lit(0)) + 1).alias("weight")), "closure-short")
    met = start.select("page_id", F.col("depth").cast("long").alias("depth"))
    parts, frontier = [met], met
    while True:
        reached = short.join(frontier, "page_id").groupBy(F.col("member").alias("page_id")).agg(F.min(F.col("depth") + F.col("weight")).alias("depth"))
        better = reached.join(reduce(DataFrame.unionByName, parts).groupBy("page_id").agg(F.min("depth").alias("_known")), "page_id", "left").where("_known IS NULL OR depth < _known").drop("_known")
        frontier = materialise(better, "closure")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > ROUNDS_TOGETHER:
            parts = [materialise(reduce(DataFrame.unionByName, parts).groupBy("page_id").agg(F.min("depth").alias("depth")), "closure")]
    known = reduce(DataFrame.unionByName, parts).groupBy("page_id").agg(F.min("depth").alias("depth"))
    within = inner.join(known.withColumnRenamed("page_id", "head"), "head").select("page_id", (F.col("depth") + F.col("dist")).alias("depth"))
    return known.unionByName(within).join(start.select("page_id"), "page_id", "left_anti").select("page_id", F.col("depth").cast("int").alias("depth"))


def induced(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN14: links with both ends among the nodes (``page_id``)."""
    ids = nodes.select("page_id").distinct()
    return links.join(ids.toDF("source_id"), "source_id", "left_semi").join(ids.toDF("target_id"), "target_id", "left_semi").select(links.columns)
