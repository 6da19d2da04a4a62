"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Digests are counted first; a text whose digest occurs once equals no other and is not moved. The others are combined:

1. *Local*: the map side of the first aggregation folds equal texts within a task.
2. *Salted*: what is left is merged by (digest, salt, text), so the copies of a
   hot text meet in several tasks.
3. *Global*: the few salt winners of a text are combined by (digest, text).

Each stage groups by the text itself beside its digest, so texts with the same
digest never merge. Group sizes and winners then go back to the rows by digest;
only texts whose digest is shared by another text are compared in full once more.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.columns import ROW, carried, restored
from palimpsest.storage import materialise

SALTS = 16
#: Repeated digests, eight bytes each, are sent to all executors up to so many; beyond, they are joined by shuffle.
BROADCAST_KEYS = 2_000_000


def normalised(text: Column) -> Column:
    """``text`` with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def exact_groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct ``norm`` of ``rows`` (``doc_id, norm, digest, row``): ``digest, norm, first, group_size``.

    ``first`` is the row that stays: the smallest non-null ``doc_id``, then the smallest ``row``.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    keyed = rows.select("digest", "norm", rank.alias("rank"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = keyed.groupBy("digest", "salt", "norm").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "norm").agg(F.min("first").alias("first"), F.sum("group_size").alias("group_size"))


class Repeats(NamedTuple):
    """64-bit keys of the digests that occur more than once, and whether they are few enough for every executor."""

    keys: DataFrame
    few: bool

    def matched(self, rows: DataFrame, how: str) -> DataFrame:
        """``rows`` whose ``key`` is (``left_semi``) or isn't (``left_anti``) among them."""
        return rows.join(F.broadcast(self.keys) if self.few else self.keys, "key", how)


def repeats(keyed: DataFrame) -> Repeats:
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    keys = materialise(counted, "repeated-digests")
    return Repeats(keys, keys.count() <= BROADCAST_KEYS)


def judged(rows: DataFrame, repeated: Repeats, salts: int = SALTS) -> DataFrame:
    """The rows of repeated digests, as numbered and written once, with ``keep_id, group_size`` and ``kept``."""
    again = materialise(repeated.matched(rows, "left_semi").withColumn("row", F.monotonically_increasing_id()), "repeated-texts")
    digests = exact_groups(again, salts).groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"), F.min("first").alias("first"), F.min("group_size").alias("group_size"))
    digests = materialise(digests, "exact-dedup")
    alone = digests.where("n_texts = 1").drop("n_texts")
    found = again.join(F.broadcast(alone) if repeated.few else alone, "digest")
    shared = digests.where("n_texts > 1").select("digest")
    if not shared.isEmpty():
        groups = exact_groups(again, salts).join(shared, "digest", "left_semi")
        found = found.unionByName(again.join(groups, ["digest", "norm"]))
    return found.withColumns({"keep_id": F.col("first.doc_id"), "kept": F.col("row") == F.col("first.row")})


def _keyed(docs: DataFrame, digest, *extra: Column) -> DataFrame:
    rows = docs.select(*extra, "doc_id", normalised(F.col("text")).alias("norm")).withColumn("digest", digest(F.col("norm")))
    return rows.withColumn("key", F.xxhash64("digest"))


def exact_dedup(docs: DataFrame, digest=digest_of, salts: int = SALTS) -> DataFrame:
    """Which row of each group of equal texts stays.

    Returns one row per row of ``docs``: ``doc_id, keep_id, group_size, kept,
    text_sha256``. The row with the smallest non-null doc_id of a group stays; of
    rows that repeat that doc_id and text, one. Null text counts as empty; rows with null
    doc_ids are counted, but one stays only (``keep_id`` null) if its
    group has no other id. An empty table gives an empty result; other columns
    of ``docs`` are ignored whatever their names.
    """
    rows = _keyed(docs, digest)
    sha = F.sha2("norm", 256).alias("text_sha256")
    small = materialise(rows.select("doc_id", "key", sha), "digests")
    repeated = repeats(small)
    alone = repeated.matched(small, "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(judged(rows, repeated, salts).select("doc_id", "keep_id", "group_size", "kept", sha))


def drop_copies(docs: DataFrame, digest=digest_of, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = _keyed(docs, digest, carried(docs))
    repeated = repeats(rows.select("key"))
    again = judged(rows, repeated, salts).where("kept").select(ROW)
    return restored(repeated.matched(rows.select(ROW, "key"), "left_anti").select(ROW).unionByName(again), docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
