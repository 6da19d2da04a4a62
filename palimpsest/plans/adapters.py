"""The driver's tables in the shapes of the wiki model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.schemas import ARTICLE, CATEGORIZATION, REDIRECT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``: a user is a page, an event a revision, its type the author."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("revision_id"), "ts", F.col("event_type").alias("author"), "props")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations``: a conversation is a page, a turn a revision."""
    talk = table(spark, sf_dir, "conversations")
    return talk.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("revision_id"), F.col("turn").alias("ts"), F.col("role").alias("author"), "text")


def category_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers belong to nations, nations to regions; ids are spread so that they don't meet."""
    layer = F.lit("3000-01-01").cast("timestamp_ntz").alias("ts")
    kind = F.lit(CATEGORIZATION).alias("link_type")
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("source_id"), F.col("n_regionkey").cast("long").alias("target_id"), kind, layer)
    out = nation
    for name, offset in (("customer", 1_000_000_000), ("supplier", 2_000_000_000)):
        c = name[0]
        out = out.unionByName(table(spark, sf_dir, name).select((F.col(f"{c}_{name[:4]}key") + offset).cast("long").alias("source_id"), (F.col(f"{c}_nationkey") + 100).cast("long").alias("target_id"), kind, layer))
    return out


def article_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem``: an order links to parts, by ship month; the line status gives the type."""
    items = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", REDIRECT).when(F.col("l_returnflag") == "R", CATEGORIZATION).otherwise(ARTICLE)
    return items.select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), kind.alias("link_type"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts"))


CATEGORY_LINKS_SQL = """
  SELECT n_nationkey::BIGINT + 100 AS source_id, n_regionkey::BIGINT AS target_id FROM nation
  UNION ALL SELECT c_custkey + 1000000000, c_nationkey::BIGINT + 100 FROM customer
  UNION ALL SELECT s_suppkey + 2000000000, s_nationkey::BIGINT + 100 FROM supplier
"""
ARTICLE_LINKS_SQL = """
  SELECT l_orderkey AS source_id, l_partkey AS target_id,
         CASE l_returnflag WHEN 'A' THEN 'REDIRECT' WHEN 'R' THEN 'CATEGORIZATION' ELSE 'ARTICLE' END AS link_type,
         date_trunc('month', l_shipdate)::TIMESTAMP AS ts FROM lineitem
"""
