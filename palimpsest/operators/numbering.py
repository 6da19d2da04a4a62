"""Global row numbers without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.storage import materialise


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with ``name`` = 1, 2, ... in the order of the columns ``order``.

    Rows are sorted by ranges and written once; only the sizes of the ranges, one per
    partition, are added up.
    """
    place = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = materialise(ranged.select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "numbering")
    starts, total = [], 0
    for r in sorted(fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # one row per partition
        starts.append((r["_part"], total))
        total += r["n"]
    lookup = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    return fixed.join(F.broadcast(lookup), "_part").select(*rows.columns, (F.col("_start") + F.col("_place") + 1).alias(name))
