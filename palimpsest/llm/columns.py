"""Carry whole rows through steps whose own column names might clash with theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_carried"


def carried(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct column."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]).alias(ROW)


def restored(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The carried columns again, in order, some of them replaced."""
    return df.select(*[replaced[c].alias(c) if c in replaced else F.col(f"{ROW}.`{c}`").alias(c) for c in columns])
