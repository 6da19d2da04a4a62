"""Reproducible sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of (doc_id, text checksum, size). A keyed
Feistel network permutes the smallest power of four not below n; a value that
falls outside 0..n-1 is encrypted again until it falls inside (cycle walking), which
is a permutation of 0..n-1. Place p of that permutation is shard ``p % shards``
and slot ``p // shards``, so both can be computed for any row number, and
``row_number_at`` gives the row of any place, without a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.storage import materialise

SHARDS = 8
#: Round keys; fixed so that a run can be repeated.
KEYS = (918273645, 135792468, 246813579, 1029384756)
#: Fixed multipliers of the round function, odd and below 2**30.
MULTIPLIERS = (747796405, 668265263)
MASK = (1 << 31) - 1


def half_bits(n: int) -> int:
    """Bits of half a block: the network permutes 0 .. 4**bits - 1, at least n values."""
    return max(1, (max(0, n - 1).bit_length() + 1) // 2)


def _mixed(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    x = (half + key) & MASK
    x = (x * MULTIPLIERS[0]) & MASK
    x ^= x >> 15
    x = (x * MULTIPLIERS[1]) & MASK
    x ^= x >> 13
    return x & ((1 << bits) - 1)


def _network(x: np.ndarray, bits: int, keys) -> np.ndarray:
    left, right = x >> bits, x & ((1 << bits) - 1)
    for key in keys:
        left, right = right, left ^ _mixed(right, key, bits)
    return (left << bits) | right


def _inverse_network(x: np.ndarray, bits: int, keys) -> np.ndarray:
    left, right = x >> bits, x & ((1 << bits) - 1)
    for key in reversed(keys):
        left, right = right ^ _mixed(left, key, bits), left
    return (left << bits) | right


def _walked(step, x: np.ndarray, n: int, bits: int, keys) -> np.ndarray:
    x = step(np.asarray(x, dtype=np.int64), bits, keys)
    while (outside := np.flatnonzero(x >= n)).size:
        x[outside] = step(x[outside], bits, keys)
    return x


def permuted(rows: np.ndarray, n: int, keys=KEYS) -> np.ndarray:
    """Places of row numbers below n."""
    return _walked(_network, rows, n, half_bits(n), keys)


def row_number_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, keys=KEYS) -> np.ndarray:
    """Row numbers of places, the inverse of ``permuted``."""
    return _walked(_inverse_network, np.asarray(slot, dtype=np.int64) * shards + np.asarray(shard, dtype=np.int64), n, half_bits(n), keys)


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, size, text_crc32, row`` with global row numbers, and their count.

    Rows are sorted by ranges; rows that agree in all three sorted columns are
    interchangeable, so that the last sort key may split even a hot doc_id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("_at")
    )
    keys = ["doc_id", "text_crc32", "size"]
    ordered = small.repartitionByRange(*keys, "_at").sortWithinPartitions(*keys).drop("_at")
    place = F.monotonically_increasing_id()
    ordered = materialise(ordered.select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_in_part")), "sharding")
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
    starts, total = {}, 0
    for r in sorted(sizes):
        starts[r["_part"]] = total
        total += r["n"]
    lookup = docs.sparkSession.createDataFrame(list(starts.items()), "_part long, _start long")
    rows = ordered.join(F.broadcast(lookup), "_part").select("doc_id", "size", "text_crc32", (F.col("_start") + F.col("_in_part")).alias("row"))
    return rows, total


def shard(docs: DataFrame, shards: int = SHARDS, keys=KEYS) -> DataFrame:
    """Shard and slot of every row, by the law ``rows``: counts differ by one at most.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, row``.
    ``size`` is the UTF-8 length plus 1 (null text: 1). ``grown_shard`` is null:
    the law deals rows out anew for another shard count. Rows with null or
    repeated doc_ids are numbered like any other; an empty table gives an
    empty result; other columns of ``docs`` are ignored.
    """
    rows, n = numbered(docs)
    schema = T.StructType(
        [*rows.schema.fields[:3], T.StructField("law", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("grown_shard", T.IntegerType()), T.StructField("row", T.LongType())]
    )

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place = permuted(batch["row"].to_numpy(), n, keys)
            yield batch.assign(law="rows", shard=(place % shards).astype(np.int32), slot=place // shards, grown_shard=None)[schema.names]

    return rows.mapInPandas(deal, schema)

