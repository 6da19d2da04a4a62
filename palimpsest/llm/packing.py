"""Best-fit packing of token sequences by large-item matching.

Whole documents are kept together; only those longer than the capacity are
cut. How many pieces there are of each length (at most ``capacity`` numbers) decides
the packing, so it is planned on that histogram and then applied to all rows:

* Pieces above a third of the capacity fit at most two to a sequence, so they
  are matched greedily: the largest left takes the largest other one that fits.
* Smaller pieces, longest first, go to the tightest gap that takes them; a new
  sequence opens when none does.

A plan is a list of segments: pieces number a..b of one length go to sequences
s..s+b-a, all at one offset. Its size depends on the capacity, not on the input.
Pieces are numbered within (partition, length), then across partitions, so
that no length, however frequent, meets in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.storage import materialise
from palimpsest.llm.word_tokens import word_encoder

CAPACITY = 2048
END_ID = 0
#: Numbers of the first ranks, one for each partition and length, that are sent to all executors up to so many; beyond, they are joined by shuffle.
BROADCAST_RANKS = 8_000_000
#: Bytes of texts that are encoded together, and the last of them may go beyond.
GROUP_BYTES = 1 << 21
#: Partitions whose first ranks are laid out together.
GROUP = 256


class Segment(NamedTuple):
    """Pieces ``rank .. rank + count - 1`` of ``length`` at ``offset`` of sequences from ``sequence``."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


class _Gaps:
    """Open sequences by the room left: runs (first sequence, how many) of neighbouring numbers."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def add(self, gap: int, start: int, count: int) -> None:
        if gap and count:
            if gap not in self.runs:
                self.runs[gap] = []
                bisect.insort(self.sizes, gap)
            self.runs[gap].append((start, count))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """A run with the smallest gap that is ``length`` or more: gap, start, count."""
        i = bisect.bisect_left(self.sizes, length)
        if i == len(self.sizes):
            return None
        gap = self.sizes[i]
        start, count = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap], self.sizes[i]
        return gap, start, count


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Segment]:
    """Where the pieces of each length go; deterministic, for lengths from 1 to ``capacity``."""
    if any(not 1 <= length <= capacity for length in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    left = {length: n for length, n in histogram.items() if n > 0}
    next_rank = dict.fromkeys(left, 0)
    segments: list[Segment] = []
    gaps, opened = _Gaps(), 0

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        segments.append(Segment(length, next_rank[length], count, sequence, offset))
        next_rank[length] += count
        left[length] -= count

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for length in large:
        while left[length]:
            mate = next((x for x in large if x <= capacity - length and left[x] and (x != length or left[x] > 1)), None)
            if mate is None:
                count, used = left[length], length
                place(length, count, opened, 0)
            else:
                count = left[length] // 2 if mate == length else min(left[length], left[mate])
                used = length + mate
                place(length, count, opened, 0)
                place(mate, count, opened, length)
            gaps.add(capacity - used, opened, count)
            opened += count
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            run = gaps.take(length)
            if run is None:
                each = capacity // length
                full, rest = divmod(left[length], each)
                for n, per in ((full, each), (1 if rest else 0, rest)):
                    for k in range(per if n else 0):
                        place(length, n, opened, k * length)
                    gaps.add(capacity - per * length, opened, n)
                    opened += n
                break
            gap, start, count = run
            each = gap // length
            full = min(count, left[length] // each)
            for k in range(each if full else 0):
                place(length, full, start, capacity - gap + k * length)
            gaps.add(gap - each * length, start, full)
            if full < count and (rest := left[length]):
                for k in range(rest):
                    place(length, 1, start + full, capacity - gap + k * length)
                gaps.add(gap - rest * length, start + full, 1)
                full += 1
            gaps.add(gap, start + full, count - full)
    return segments


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows, cut behind the text that fills a group."""
    filled = pc.binary_length(batch["text"]).to_numpy().cumsum(dtype=np.int64) // GROUP_BYTES
    for a, b in pairwise([0, *(np.flatnonzero(np.diff(filled, prepend=0)) + 1).tolist(), batch.num_rows]):
        if a < b:
            yield batch.slice(a, b - a)


def tokenised(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document, numbered within (partition, length).

    Columns ``doc_id, piece, start, length, ids_crc32, part, part_rank`` and,
    with ``keep_ids``, ``ids`` (array of int).
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    id_field = docs.schema["doc_id"]
    ids = ", ids array<int>" if keep_ids else ""
    schema = f"doc_id {id_field.dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, part_rank long{ids}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_file)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in (group for b in batches for group in _groups(b)):
            ids, counts = encoder.encode_all(batch["text"])
            ids, counts = np.insert(ids, counts.cumsum(), end_id), counts + 1
            pieces = -(-counts // capacity)
            at = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(at)) - (pieces.cumsum() - pieces)[at]
            start = piece * capacity
            length = np.minimum(counts[at] - start, capacity)
            edges = np.concatenate([[0], length.cumsum()])
            data = memoryview(ids).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in pairwise(edges.tolist())]
            order = np.argsort(length, kind="stable")
            rank = np.empty_like(length)
            rank[order] = np.arange(len(order)) - np.searchsorted(length[order], length[order])
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            at = pa.array(at, pa.int64())
            columns = [batch["doc_id"].take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), batch["part"].take(at), pa.array(rank, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "part_rank"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.view("<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset`` and, with ``keep_ids``, ``ids``. Null and empty texts are one piece that
    holds the end id alone. Rows with null or repeated doc_ids are packed each on
    their own; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = materialise(tokenised(docs, tokenizer_file, capacity, end_id, keep_ids), "packing")
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    by_part = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    per_part = materialise(per_part.select("part", "length", "n", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    segments = plan(histogram, capacity)
    known = F.collect_list(F.struct("length", "before")).alias("known")  # at most ``capacity`` entries

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, GROUP) for b in batches for i in range(0, b.num_rows, GROUP)):
            entries, sizes = batch["known"].flatten(), pc.list_value_length(batch["known"]).to_numpy()
            before = np.zeros((batch.num_rows, capacity), dtype=np.int64)
            before[np.repeat(np.arange(batch.num_rows), sizes), pc.struct_field(entries, "length").to_numpy() - 1] = pc.struct_field(entries, "before").to_numpy()
            edges = pa.array(np.arange(batch.num_rows + 1) * capacity, pa.int32())
            yield pa.RecordBatch.from_arrays([batch["part"], pa.ListArray.from_arrays(edges, pa.array(before.ravel()))], names=["part", "before"])

    firsts = materialise(per_part.groupBy("part").agg(known).mapInArrow(lay_out, "part int, before array<long>"), "packing-ranks")
    few = firsts.count() * capacity <= BROADCAST_RANKS
    numbered = pieces.join(F.broadcast(firsts) if few else firsts.hint("merge"), "part").withColumn("rank", F.element_at("before", F.col("length").cast("int")) + F.col("part_rank")).drop("before")
    return _placed(spark, numbered, segments, keep_ids)


def _placed(spark: SparkSession, numbered: DataFrame, segments: list[Segment], keep_ids: bool) -> DataFrame:
    """Look up each piece's segment; the plan's size is bounded by the capacity, so every task gets all of it."""
    order = np.array(sorted(segments), dtype=np.int64).reshape(-1, 5)
    lengths = order[:, 0]
    first = {int(n): int(np.searchsorted(lengths, n)) for n in np.unique(lengths)}
    shared = spark.sparkContext.broadcast((order, first))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    kinds = {f.name: f.dataType.simpleString() for f in numbered.schema.fields} | {"sequence_id": "bigint", "offset": "bigint"}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, first = shared.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.empty(batch.num_rows, dtype=np.int64)
            for n in np.unique(length):
                mine, low = np.flatnonzero(length == n), first[int(n)]
                high = np.searchsorted(order[:, 0], n, "right")
                at[mine] = low + np.searchsorted(order[low:high, 1], rank[mine], "right") - 1
            found = order[at]
            new = {"sequence_id": pa.array(found[:, 3] + rank - found[:, 1]), "offset": pa.array(found[:, 4])}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch[n] for n in names], names=names)

    return numbered.mapInArrow(place, ", ".join(f"`{n}` {kinds[n]}" for n in names))
