"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of parts. Each pair of neighbours that has a
merge rank waits in the bucket of its rank; three levels of 64-way bitmaps tell the
lowest rank in use with three find-first-set steps. A merge pushes the two
pairs it makes; entries whose pair has changed since are skipped when they come up.
Time is near linear in the length of a pre-token, so very long ones do no harm.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.word_tokens import Halves

#: Distinct entries that each half of a cache holds.
CACHE_STRETCHES = 150_000
CACHE_PIECES = 400_000
BITS = [1 << i for i in range(64)]
#: White space as the public patterns mean it.
WHITE = "\t-\r \x85\xa0  -     　"


class RankQueue:
    """Positions by merge rank, ranks below ``2**18``; empty again after each pre-token, so that one serves all.

    A bucket is -1 if empty, the position if there is one, else a heap of positions.
    """

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self) -> None:
        self.buckets: list = [-1] * (1 << 18)
        self.low = [0] * (1 << 12)
        self.mid = [0] * (1 << 6)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        held = self.buckets[rank]
        if held == -1:
            self.buckets[rank] = position
            block, group = rank >> 6, rank >> 12
            bits = self.low[block]
            if not bits:
                self.mid[group] |= BITS[block & 63]
                self.top |= BITS[group]
            self.low[block] = bits | BITS[rank & 63]
        elif type(held) is int:
            self.buckets[rank] = [held, position] if held < position else [position, held]
        else:
            heapq.heappush(held, position)

    def pop(self) -> tuple[int, int]:
        """The leftmost position of the lowest rank."""
        top, mid, low = self.top, self.mid, self.low
        group = (top & -top).bit_length() - 1
        blocks = mid[group]
        block = group << 6 | (blocks & -blocks).bit_length() - 1
        bits = low[block]
        rank = block << 6 | (bits & -bits).bit_length() - 1
        held = self.buckets[rank]
        if type(held) is int:
            position = held
        else:
            position = heapq.heappop(held)
            if held:
                return rank, position
        self.buckets[rank] = -1
        low[block] = bits = bits & (bits - 1)
        if not bits:
            mid[group] = blocks = blocks & (blocks - 1)
            if not blocks:
                self.top = top & (top - 1)
        return rank, position


def load_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a rank file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merged(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Ids of one pre-token: the lowest-ranked pair merges first, the leftmost among equals."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    push, pop, rank_of = queue.push, queue.pop, ranks.get
    waiting = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]
    waiting.append(-1)
    for i, rank in enumerate(waiting):
        if rank >= 0:
            push(rank, i)
    while queue.top:
        rank, i = pop()
        if waiting[i] != rank:
            continue
        j = after[i]
        waiting[i] = waiting[j] = -1
        end = after[i] = after[j]
        if end < n:
            before[end] = i
            waiting[i] = rank = rank_of(piece[i : after[end]], -1)
            if rank >= 0:
                push(rank, i)
        h = before[i]
        if h >= 0:
            waiting[h] = rank = rank_of(piece[h:end], -1)
            if rank >= 0:
                push(rank, h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class BytePairEncoder:
    """Encodes texts; ids are looked up by stretch of text, and merged only for new pre-tokens.

    A stretch is a space, if there is one, and what follows up to the next white space.
    The pattern never matches across the end of a stretch, so it is applied to
    each distinct stretch once.
    """

    def __init__(self, rank_file: str, pattern: str) -> None:
        import regex

        self.ranks = load_ranks(rank_file)
        self.queue = RankQueue()
        self.pieces = regex.compile(pattern).findall
        self.stretches = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall
        self.known = Halves(CACHE_STRETCHES)
        self.parts = Halves(CACHE_PIECES)

    def _piece(self, piece: str) -> bytes:
        return array("I", merged(piece.encode(), self.ranks, self.queue)).tobytes()

    def _stretch(self, stretch: str) -> bytes:
        return b"".join(self.parts.fill(self.pieces(stretch), self._piece))

    def encode_bytes(self, text: str) -> bytes:
        """Ids of the whole text, each as four little-endian bytes."""
        self.known.trim(), self.parts.trim()
        return b"".join(self.known.fill(self.stretches(text), self._stretch))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()


@cache
def byte_pair_encoder(rank_file: str, pattern: str) -> BytePairEncoder:
    """One encoder for all tasks of a Python worker, so that what it learnt stays."""
    return BytePairEncoder(rank_file, pattern)


@cache
def vocabulary(rank_file: str) -> pa.LargeBinaryArray:
    """Each rank's bytes, at its place; null where the file leaves a rank out."""
    token = {rank: token for token, rank in load_ranks(rank_file).items()}
    return pa.array([token.get(rank) for rank in range(max(token, default=-1) + 1)], pa.large_binary())


def joined(ids: pa.ListArray, tokens: pa.LargeBinaryArray) -> pa.Array:
    """The bytes of each row's ids: taken one behind the other, the tokens of a row are its text."""
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    taken = tokens.take(pc.list_flatten(ids))
    if taken.null_count:
        raise ValueError("ids that the rank file lacks")
    bounds = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][np.cumsum([0, *lengths])] if len(taken) else np.zeros(len(ids) + 1, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(bounds.tobytes()), taken.buffers()[2]])


def encode(docs: DataFrame, rank_file: str, pattern: str, group: int = 512) -> DataFrame:
    """Token ids of every whole text: ``doc_id, ids`` (array of int), row by row.

    Null text counts as empty and gives an empty array; doc_ids may be null or
    repeat; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_pair_encoder(rank_file, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, group):
                part = batch.slice(start, group)
                encoded = [encoder.encode_bytes(text) for text in part["text"].to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in encoded)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, rank_file: str) -> DataFrame:
    """The bytes of every row's ids, beside all columns of ``tokens``: ``decoded`` (binary).

    A null array counts as empty. An id that the rank file lacks raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = joined(batch["ids"], vocabulary(rank_file)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{fields}, decoded binary")


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded again."""
    tokens = decode(encode(docs, rank_file, pattern), rank_file)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
