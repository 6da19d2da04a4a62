"""How well one link layer agrees with another, and what compression saves (AG7, AG8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.schemas import LINK_TYPES


def page_scores(gold: DataFrame, test: DataFrame, types=LINK_TYPES) -> DataFrame:
    """``page_id, link_type, n_gold, n_test, n_both`` of the pages with links in either layer.

    Both layers have ``page_id, link_type, target_id``; they meet in one aggregation by link.
    """
    tagged = gold.select("page_id", "link_type", "target_id", F.lit(1).alias("g"), F.lit(0).alias("t")).unionByName(
        test.select("page_id", "link_type", "target_id", F.lit(0).alias("g"), F.lit(1).alias("t"))
    )
    edges = tagged.where(F.col("link_type").isin(*types)).groupBy("page_id", "link_type", "target_id").agg(F.max("g").alias("g"), F.max("t").alias("t"))
    return edges.groupBy("page_id", "link_type").agg(F.sum("g").alias("n_gold"), F.sum("t").alias("n_test"), F.sum(F.col("g") * F.col("t")).alias("n_both"))


def link_evaluation(pages: DataFrame, gold: DataFrame, test: DataFrame, types=LINK_TYPES) -> DataFrame:
    """AG7: ``link_type, recall, precision, f_score, page_count``, means over all pages.

    A page without gold links has recall 1, without test links precision 1. Pages without any
    link score 1 in all three, so they are counted rather than joined.
    """
    scores = page_scores(gold, test, types).join(pages.select("page_id").distinct(), "page_id", "left_semi")
    recall = F.when(F.col("n_gold") == 0, 1.0).otherwise(F.col("n_both") / F.col("n_gold"))
    precision = F.when(F.col("n_test") == 0, 1.0).otherwise(F.col("n_both") / F.col("n_test"))
    rated = scores.withColumn("r", recall).withColumn("p", precision)
    f = F.when(F.col("r") + F.col("p") > 0, 2 * F.col("r") * F.col("p") / (F.col("r") + F.col("p"))).otherwise(0.0)
    sums = rated.withColumn("f", f).groupBy("link_type").agg(F.sum("r").alias("r"), F.sum("p").alias("p"), F.sum("f").alias("f"), F.count(F.lit(1)).alias("n"))
    total = pages.agg(F.countDistinct("page_id").alias("page_count"))
    kinds = pages.sparkSession.createDataFrame([(t,) for t in types], "link_type string")
    grid = kinds.join(F.broadcast(total), F.lit(True)).join(F.broadcast(sums), "link_type", "left")  # a row per type
    mean = lambda c: (F.coalesce(c, F.lit(0.0)) + F.col("page_count") - F.coalesce("n", F.lit(0))) / F.col("page_count")
    return grid.where("page_count > 0").select("link_type", mean("r").alias("recall"), mean("p").alias("precision"), mean("f").alias("f_score"), "page_count")


def compression_statistics(texts: DataFrame) -> DataFrame:
    """AG8: ``ratio_percent`` and ``diff_share`` of rows with ``raw_bytes, stored_bytes, codec``."""
    return texts.agg(
        (100.0 * F.sum("stored_bytes") / F.sum("raw_bytes")).alias("ratio_percent"), F.avg(F.when(F.col("codec") == "DIFFBZIP2", 1.0).otherwise(0.0)).alias("diff_share")
    )
