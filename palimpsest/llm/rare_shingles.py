"""Candidates for similar shingle sets inside crowds of documents that resemble each other.

All shingles of a crowd are put in one order, from rare to frequent. If two sets have
a Jaccard similarity of at least s, then their first common shingle lies among the first
``n - ceil(s * n) + 1`` of each, and neither has passed so many shingles before it that the
rest is too small. Only those first shingles are joined, so what all of the crowd has in common brings
no pairs. Any order loses nothing; the rarer the first shingles, the fewer pairs there are.

Two sets that have one first shingle in common mostly have many. As all are in one order, a pair whose sets
had a joined shingle in common shortly before has been met there already, and is not listed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.storage import by_shuffle, materialise

#: Shingles are counted by their hash modulo this, so that the counts have a fixed size.
COUNTERS = 1 << 18
#: Bins of hashes whose parities are compared, by the top eight bits of a hash.
BINS = 256
#: Columns that hold these parities.
COARSE = [f"sketch{i}" for i in range(BINS // 64)]
#: Joined shingles before one that are looked at for an earlier meeting of a pair.
LOOK_BACK = 4
#: Texts handled together.
GROUP = 256
#: Keeps products of whole numbers and the similarity from being rounded up.
TINY = 1e-9

Hashes = Callable[[str], np.ndarray]


def _counter(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(COUNTERS - 1)).astype(np.int64)


def frequencies(texts: DataFrame, hashes: Hashes) -> np.ndarray:
    """How many shingles of all rows fall to each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(counts, _counter(np.unique(hashes(text.as_py()))), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["counter", "n"])

    counted = texts.select("text").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[counted["counter"].to_numpy()] = counted["n"].to_numpy()
    return counts


def first_shingles(found: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the common order; a set without shingles has zero alone."""
    if not len(found):
        return np.zeros(1, dtype=np.uint64)
    order = np.lexsort((found, counts[_counter(found)]))
    return found[order[: len(found) - ceil(similarity * len(found) - TINY) + 1]]


def parities(found: np.ndarray) -> np.ndarray:
    """For each of ``BINS`` bins of hashes, whether an odd number falls to it; as signed 64-bit words.

    The bits in which two of these differ are at most the shingles that only one of the sets has.
    """
    odd = np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=BINS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def sketch(found: np.ndarray) -> np.ndarray:
    """The parities of as many bins, by the low bits of a hash, as the set has shingles: the next power of two, ``BINS`` at least."""
    bins = max(BINS, 1 << (len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def sketches_apart(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ, the longer one folded to the length of the other; null if it is more than twice as long."""
    words = F.least(F.size(a), F.size(b))

    def folded(x: Column) -> Column:
        halves = F.zip_with(F.slice(x, F.lit(1), words), F.slice(x, words + 1, words), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) == words, x).when(F.size(x) == 2 * words, halves)

    bits = F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda total, x: total + x)


def _least_common(similarity: float) -> Column:
    """Shingles that sets of the sizes ``n_a, n_b`` have in common at least if they are similar."""
    return similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - TINY


def _most_apart(similarity: float) -> Column:
    """Shingles that only one of them has, at most."""
    return F.col("n_a") + F.col("n_b") - 2 * _least_common(similarity)


def meetings(rows: DataFrame, similarity: float, close: Column) -> DataFrame:
    """``a, b`` (b < a) of the rows ``doc_id, root, place, shingle, before, n`` and sketches that meet in a shingle and may be similar.

    A pair is left out where the shingles before show that it met already. Its first meeting has no common one before, so no pair is lost.
    """
    left, right = (rows.toDF(*(c if c == "shingle" and side == "a" else f"{'' if c == 'doc_id' else c + '_'}{side}" for c in rows.columns)) for side in "ab")
    enough = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= _least_common(similarity)
    apart = sum((F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in COARSE), F.lit(0))
    few = apart <= _most_apart(similarity)
    first = ~F.arrays_overlap("before_a", "before_b")
    met = by_shuffle(left).join(right, (F.col("shingle") == F.col("shingle_b")) & (F.col("b") < F.col("a")) & (F.col("root_a") != F.col("root_b")) & enough & few & close & first)
    return met.select("a", "b")


def rare_pairs(texts: DataFrame, hashes: Hashes, fingerprint: Callable[[str], int], similarity: float, close: Column, roots: DataFrame | None = None) -> DataFrame:
    """``a, b`` (b < a) of the rows ``doc_id, text`` whose sets may be similar, each pair once.

    ``close`` is a further condition on the fingerprints ``fp_a, fp_b`` and set sizes ``n_a, n_b``.
    ``roots`` (``node, root``) names groups of doc_ids that are linked already: pairs inside one are left
    out, and shingles that only one group has are dropped before they are joined.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequencies(texts, hashes))
    names = ["doc_id", "fp", "n", *COARSE, "sketch", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, GROUP) for b in batches for i in range(0, b.num_rows, GROUP)):
            rows, fine, first = [], [], []
            for text in batch["text"].to_pylist():
                found = np.unique(hashes(text))
                rows.append([fingerprint(text), len(found), *parities(found).tolist()])
                fine.append(sketch(found))
                first.append(first_shingles(found, shared.value, similarity).view(np.int64))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns, pa.array(fine, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))], names=names)

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, fp long, n long, {', '.join(f'{x} long' for x in COARSE)}, sketch array<long>, first array<long>"
    nodes = materialise(texts.select("doc_id", "text").mapInArrow(run, schema), "first-shingles")
    if roots is not None:
        nodes = nodes.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    else:
        nodes = nodes.withColumn("root", F.col("doc_id"))
    places = nodes.select("doc_id", "root", F.posexplode("first").alias("place", "shingle"))
    mixed = places.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    shared_places = places.select("doc_id", "place", "shingle").join(mixed, "shingle", "left_semi")
    before = F.collect_list("shingle").over(Window.partitionBy("doc_id").orderBy("place").rowsBetween(-LOOK_BACK, -1))
    rows = materialise(shared_places.withColumn("before", before).join(nodes.drop("first", "sketch"), "doc_id"), "shared-shingles")
    pairs = materialise(meetings(rows, similarity, close).distinct(), "rare-pairs")
    fine_a, fine_b = (nodes.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"fine_{side}")) for side in "ab")
    near = sketches_apart(F.col("fine_a"), F.col("fine_b")) <= _most_apart(similarity)
    return pairs.join(fine_a, "a").join(fine_b, "b").where(F.coalesce(near, F.lit(True))).select("a", "b")
