"""Histories stored as delta chains, of which a read takes only those it needs (TT6, CMP6 of the survey).

A store is a folder with two tables. ``chains`` has the coded texts, split into buckets by chain and sorted by page, chain
and place, so a file holds few pages. ``index`` says of every revision which chain it is in, and where; it is split into
buckets by page. A read first finds the chains of the revisions asked for, then reads the buckets and pages these are
in, up to the last place asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.codecs import compress_history, decode_history
from palimpsest.operators.history import PAGE_KEY
from palimpsest.schemas import KEY_FRAME_INTERVAL
from palimpsest.storage import materialise

BUCKETS = 64


def _bucket(columns, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def write(revisions: DataFrame, folder: str, text: str = "text", key=PAGE_KEY, interval: int = KEY_FRAME_INTERVAL, buckets: int = BUCKETS) -> None:
    """Store a history. Rows are cut into files by ranges, so neither a page nor a bucket has to be one task."""
    stored = materialise(compress_history(revisions, text, key, interval), "chains")
    order = ["bucket", *key, "chain", "place"]
    chains = stored.withColumn("bucket", _bucket([*key, "chain"], buckets))
    chains.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{folder}/chains")
    index = stored.select(*key, "revision_id", "ts", "chain", "place", _bucket([*key, "chain"], buckets).alias("bucket"), _bucket(key, buckets).alias("page_bucket"))
    order = ["page_bucket", *key, "ts", "revision_id"]
    index.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("page_bucket").parquet(f"{folder}/index")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """``key, revision_id, ts, chain, place`` of every stored revision, and its buckets."""
    return spark.read.parquet(f"{folder}/index")


def _within(rows: DataFrame, bucket: str, wanted: DataFrame, key) -> DataFrame:
    """``rows`` in the buckets and the range of pages that ``wanted`` has: filters that skip files. Its buckets are collected, of which there are few."""
    found = [r[0] for r in wanted.select(bucket).distinct().collect()]
    bounds = wanted.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(key) for k, f in (("low", F.min), ("high", F.max))]).first()
    ranges = [F.col(c).between(bounds[f"low{i}"], bounds[f"high{i}"]) for i, c in enumerate(key)]
    return rows.where(reduce(Column.__and__, ranges, F.col(bucket).isin(found)))


def chains_of(spark: SparkSession, folder: str, wanted: DataFrame, key=PAGE_KEY, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """The index rows of the revisions asked for (``key, revision_id``), and the stored rows that decoding them takes."""
    asked = materialise(wanted.select(*key, "revision_id", _bucket(key, buckets).alias("page_bucket")).distinct(), "asked")
    near = _within(index(spark, folder), "page_bucket", asked, key)
    found = materialise(near.join(asked, [*key, "revision_id", "page_bucket"], "left_semi").drop("page_bucket"), "found")
    needed = found.groupBy(*key, "chain", "bucket").agg(F.max("place").alias("_upto"))
    rows = _within(spark.read.parquet(f"{folder}/chains"), "bucket", found, key)
    return found, rows.join(needed, [*key, "chain", "bucket"]).where("place <= _upto").drop("_upto", "bucket")


def read(spark: SparkSession, folder: str, wanted: DataFrame, text: str = "text", key=PAGE_KEY, buckets: int = BUCKETS) -> DataFrame:
    """The stored revisions that ``wanted`` names (``key, revision_id``), with their texts and ``text_error``; unknown ones are absent.

    Revisions from a start onwards are read by naming what ``history.sequence_from`` gives for the index.
    """
    found, rows = chains_of(spark, folder, wanted, key, buckets)
    return decode_history(rows, text, key).join(found.select(*key, "revision_id"), [*key, "revision_id"], "left_semi")

