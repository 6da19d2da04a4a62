"""Tiers of pages and their attributes (PRJ4, SO2, TT10, TT11, TT13 of the survey).

A tier is a page at an instant (``page_id, ts``). An attribute's table has a row for each tier that has it, stored by
a codec (``codec, data, base_id, chain, place``); a delta is against the page's tier before in time, which ``base_id`` names by
its microseconds, as ``chain`` names the tier that the chain begins with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.codecs import CODECS, DELTA, STORED, compress, compress_history, decode_history
from palimpsest.operators.history import PAGE_KEY, revision_as_of
from palimpsest.storage import materialise

#: In place of the chain of tiers whose page had none.
NEW_PAGE = -(1 << 62)


def ordered_tiers(tiers: DataFrame, key=PAGE_KEY) -> DataFrame:
    """TT10, TT11, SO2: tiers by page, then time."""
    return tiers.orderBy(*key, "ts")


def has_attribute(value: Column) -> Column:
    """PRJ4: whether a tier has an attribute; an empty one counts."""
    return value.isNotNull()


def _as_revisions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("revision_id", F.unix_micros(F.col("ts").cast("timestamp")))


def attribute(stored: DataFrame, key=PAGE_KEY) -> DataFrame:
    """TT13, get: ``key, ts, value`` of every stored attribute; ``value_error`` is true where a delta has lost its base."""
    decoded = decode_history(_as_revisions(stored), "value", key)
    return decoded.select(*key, "ts", "value", F.col("text_error").alias("value_error"))


def encoded(values: DataFrame, codec: str, key=PAGE_KEY, last_full: bool = True) -> DataFrame:
    """``key, ts, codec, data, base_id, chain, place`` of ``key, ts, value``, in one codec; deltas start with a full tier and, if ``last_full``, end with one."""
    names = [*key, "ts", *STORED]
    rows = _as_revisions(values)
    if codec == DELTA:
        return compress_history(rows, "value", key, last_full=last_full).select(*names)
    if codec not in CODECS:
        raise ValueError(f"no such codec: {codec}")
    rows = rows.withColumn("codec", F.when(F.col("value").isNotNull(), codec)).withColumn("data", compress(F.col("value"), codec))
    return rows.select(*key, "ts", "codec", "data", F.lit(None).cast("long").alias("base_id"), F.col("revision_id").alias("chain"), F.lit(0).alias("place"))


def set_attribute(stored: DataFrame, values: DataFrame, codec: str = DELTA, key=PAGE_KEY) -> DataFrame:
    """TT13, set: ``stored`` with the new ``values`` (``key, ts, value``), which replace what their tiers had; a null value removes it.

    ``stored`` is a written table. Only the chains that new values fall into are decoded and stored anew: that of the last full tier not after the
    value's, or the page's first. All other rows stay byte for byte. Of values given twice for a tier, one counts.
    """
    names = [*key, "ts", *STORED]
    begins = _as_revisions(stored.where("place = 0")).select(*key, "ts", "revision_id", "chain")
    ends = begins.groupBy(*key).agg(F.min_by("chain", "ts").alias("_first"), F.max_by("chain", "ts").alias("_last"))
    asked = values.select(*key, "ts", "value").dropDuplicates([*key, "ts"]).withColumnRenamed("ts", "at")
    placed = revision_as_of(asked, begins, key, columns=("chain",)).withColumnRenamed("at", "ts").join(ends, list(key), "left")
    new = materialise(placed.withColumn("chain", F.coalesce("chain", "_first", F.lit(NEW_PAGE))).withColumn("_final", F.coalesce(F.col("chain") == F.col("_last"), F.lit(True))).drop("_first", "_last"), "attribute")
    touched = new.select(*key, "chain", "_final").distinct()
    kept = stored.join(touched, [*key, "chain"], "left_anti").select(*names)
    again = stored.join(touched, [*key, "chain"]).withColumnRenamed("chain", "_segment").withColumn("chain", F.col("_segment"))
    old = decode_history(_as_revisions(again), "value", key).where("NOT text_error").select(*key, "ts", "value", F.col("_segment").alias("chain"), "_final")
    merged = materialise(old.join(new.select(*key, "ts"), [*key, "ts"], "left_anti").unionByName(new).where("value IS NOT NULL").withColumnRenamed("chain", "_segment"), "attribute")
    for final in (False, True):
        segments = merged.where(F.col("_final") == final).drop("_final")
        kept = kept.unionByName(encoded(segments, codec, (*key, "_segment"), last_full=final).select(*names))
    return kept
