"""SimHash near-duplicate search by multi-index hashing.

A 64-bit fingerprint is cut into segments, each with a ball radius of its own. If the radii and one more
for each segment add up to more than ``radius``, two fingerprints that differ in at most ``radius`` bits lie in
one ball of some segment. So a small Hamming ball around each segment value is enumerated, the table of
segment values gives the matches, and whole distances are verified inside the join.
Only distinct fingerprints take part; copies come back by their fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.columns import carried, restored
from palimpsest.llm.components import components
from palimpsest.llm.rare_shingles import rare_pairs
from palimpsest.storage import by_shuffle, materialise, settled

SEED = 42
#: Hashes whose bits are added up at a time.
BLOCK = 1 << 16
#: Texts fingerprinted together.
GROUP = 256


def shingles(text: str, words: int) -> list[bytes]:
    """Word shingles of the text with A-Z lower-cased, repeats included; the whole sequence if it is shorter."""
    found = text.encode().lower().split()
    if not found:
        return []
    joined, ends, at = b" ".join(found), [], -1
    for word in found:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [joined[a:b] for a, b in zip(starts, ends[words - 1 :], strict=False)] or [joined]


def hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, SEED) for x in shingles(text, words)], dtype="<u8")


def fingerprint(found: np.ndarray) -> int:
    """Bits that more than half of the hashes have; signed 64-bit."""
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(found), BLOCK):
        bits = np.unpackbits(found[start : start + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp`` for every row; texts without words have fingerprint zero."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                part = batch.slice(start, GROUP)
                found = [fingerprint(hashes(text, words)) for text in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment; the last ones are longer."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segments(segments: int) -> Column:
    values = [F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit((1 << bits) - 1)) for low, bits in segment_bounds(segments)]
    return F.array(*[F.struct(F.lit(i).alias("segment"), value.alias("value")) for i, value in enumerate(values)])


def ball_radii(radius: int, segments: int) -> tuple[int, ...]:
    """The smallest balls, by segment, that no pair within ``radius`` escapes; -1 where none is needed."""
    each, more = divmod(radius + 1, segments)
    return tuple(each - (i >= more) for i in range(segments))


def _balls(radii: tuple[int, ...]) -> Column:
    """Masks of up to so many bits, by segment."""
    each = []
    for (_, bits), radius in zip(segment_bounds(len(radii)), radii, strict=True):
        masks = [sum(1 << b for b in chosen) for k in range(radius + 1) for chosen in combinations(range(bits), k)]
        each.append(F.array(*[F.lit(mask).cast("long") for mask in masks]).cast("array<long>"))
    return F.array(*each)


def tabled(nodes: DataFrame, segments: int) -> DataFrame:
    """One row per node and segment: the node's columns, ``segment`` and ``value``."""
    return nodes.select("*", F.inline(_segments(segments)))


def probed(nodes: DataFrame, radii: tuple[int, ...]) -> DataFrame:
    """One row per node, segment and value of the ball: the node's columns, ``segment``, ``value`` and ``mask``."""
    rows = tabled(nodes, len(radii)).select("*", F.explode(F.element_at(_balls(radii), F.col("segment") + 1)).alias("mask"))
    return rows.withColumn("value", F.col("value").bitwiseXOR(F.col("mask")))


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(distinct: DataFrame, radius: int = 2, segments: int = 2) -> DataFrame:
    """``a, b`` (a < b): all pairs of the distinct fingerprints ``fp`` within ``radius`` bits.

    A ball holds whichever of two values it is drawn around, so each pair is looked for from its smaller side only.
    """
    table = tabled(distinct, segments).withColumnRenamed("fp", "b")
    probes = probed(distinct, ball_radii(radius, segments)).drop("mask").withColumnRenamed("fp", "a")
    close = (F.col("a") < F.col("b")) & (distance("a", "b") <= radius)
    joined = by_shuffle(probes.alias("p")).join(table.alias("t"), (F.col("p.segment") == F.col("t.segment")) & (F.col("p.value") == F.col("t.value")) & close)
    return joined.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, segments: int = 2) -> DataFrame:
    """Classes of texts whose fingerprints are linked, directly or through others.

    One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits) and
    ``component_id``, the smallest doc_id of the class. Null, empty and wordless texts have
    fingerprint zero and are linked like any other; null doc_ids never name a class
    (a class of null doc_ids only has none); repeated rows come back each; an
    empty table gives an empty result; other columns are ignored.
    """
    rows = materialise(fingerprints(docs, words), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), radius, segments))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = linked.join(lowest, "root").select("fp", "component_id")
    return by_shuffle(rows).join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near copies: the share of common five-word shingles, and how candidates are searched for. Two-word
#: fingerprints of texts that are similar differ in a few bits, five-word ones in many.
SIMILARITY = 0.8
SIMILAR_WORDS = 5
SEARCH_WORDS = 2
SEARCH_RADIUS = 10
SEARCH_BALLS = (1, 1, 1)
#: Rounds that thin out large groups before the remaining pairs are listed.
THINNING_ROUNDS = 3
#: Keys of the documents in a round's pairs, eight bytes each, are sent to all executors up to so many; beyond, they are joined by shuffle.
BROADCAST_KEYS = 2_000_000


def shingle_sets(docs: DataFrame, words: int = SIMILAR_WORDS) -> DataFrame:
    """``doc_id, shingles``: the distinct hashes of every text's shingles, ascending."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, GROUP) for b in batches for i in range(0, b.num_rows, GROUP)):
            found = [np.unique(hashes(text.as_py(), words)).view("<i8") for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, shingles array<long>")


def similar(docs: DataFrame, pairs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs ``a, b`` of doc_ids whose sets of word shingles have a Jaccard similarity of at least ``similarity``.

    Only the texts of documents in a pair are hashed, once, and their sets are what is joined.
    """
    pairs = materialise(pairs.select("a", "b"), "near-pairs")
    key = F.xxhash64("doc_id")
    wanted = materialise(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).select(key.alias("_key")).distinct(), "near-wanted")
    few = wanted.count() <= BROADCAST_KEYS
    chosen = docs.withColumn("_key", key).join(F.broadcast(wanted) if few else wanted, "_key", "left_semi")
    sets = materialise(shingle_sets(chosen, words), "near-sets")
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    counted = both.select("a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))
    return counted.where(F.col("common") >= F.lit(similarity) * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def near_nodes(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, n``: the search fingerprint and the number of distinct shingles that are compared."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, GROUP) for b in batches for i in range(0, b.num_rows, GROUP)):
            texts = batch["text"].to_pylist()
            found = [fingerprint(hashes(text, SEARCH_WORDS)) for text in texts]
            sizes = [len(set(shingles(text, SIMILAR_WORDS))) for text in texts]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "fp", "n"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, n long")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id`` of the rows to drop so that of each group of near copies the first one stays.

    ``docs`` has distinct and ordered ``doc_id`` (of any type, without nulls) and ``text``. Groups are the components
    of all pairs of similar documents. Most links of large groups are found by fingerprints, without listing their pairs: the first document of
    each segment value leads it, and in each thinning round a document is compared with one
    leader in its balls, the closest or the first by turns, and needs no other leader if they are similar.
    Then all documents take part in a search by rare shingles, which loses no similar pair; only
    pairs that the links so far leave in different groups are listed.
    """
    alive = materialise(near_nodes(docs), "near-fingerprints")
    links = None
    # Sets whose sizes differ by more can't be that similar, so this loses nothing.
    sizes = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")
    close = (F.col("b") < F.col("a")) & (distance("fp_a", "fp_b") <= SEARCH_RADIUS) & sizes
    for round_number in range(THINNING_ROUNDS):
        leaders = _table(alive).groupBy("segment", "value").agg(F.min(F.struct("b", "fp_b", "n_b")).alias("first"))
        order = F.struct(distance("fp_a", "fp_b"), "b") if round_number % 2 == 0 else F.col("b")
        pairs = _met(_probes(alive), leaders.select("segment", "value", "first.*"), close).groupBy("a").agg(F.min_by("b", order).alias("b"))
        found = settled(partial(similar, docs, pairs, similarity=similarity), "near-links")
        links = found if links is None else links.unionByName(found)
        alive = alive.join(found.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    pairs = settled(lambda: rare_pairs(texts, lambda t: hashes(t, SIMILAR_WORDS), lambda t: 0, similarity, sizes, components(links)), "near-pairs")
    links = links.unionByName(settled(lambda: similar(docs, pairs, similarity=similarity), "near-links"))
    return components(links).where("node <> root").select(F.col("node").alias("doc_id"))


def _table(nodes: DataFrame) -> DataFrame:
    return tabled(nodes.select(F.col("doc_id").alias("b"), "fp", F.col("n").alias("n_b")), len(SEARCH_BALLS)).withColumnRenamed("fp", "fp_b")


def _probes(nodes: DataFrame) -> DataFrame:
    return probed(nodes.select(F.col("doc_id").alias("a"), "fp", F.col("n").alias("n_a")), SEARCH_BALLS).drop("mask").withColumnRenamed("fp", "fp_a")


def _met(probes: DataFrame, table: DataFrame, close: Column) -> DataFrame:
    return by_shuffle(probes.alias("p")).join(table.alias("t"), (F.col("p.segment") == F.col("t.segment")) & (F.col("p.value") == F.col("t.value")) & close)


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near copies, all columns kept: of each group the row with the smallest doc_id stays.

    Rows are told apart by doc_id and text, so rows that share a doc_id but not a text are judged each; rows that
    repeat both leave one. A row without a doc_id counts as the last of its group. Texts without words are
    copies of each other; an empty table gives an empty result.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    key, unique = F.col("doc_id"), odd.isEmpty()
    if not unique:
        key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"))
    texts = docs.select(key.alias("doc_id"), "text")
    rows = docs.select(carried(docs), key.alias("_key"))
    if not unique:
        texts, rows = texts.dropDuplicates(["doc_id"]), rows.dropDuplicates(["_key"])
    gone = settled(lambda: near_copies(texts, similarity).withColumnRenamed("doc_id", "_gone"), "near-copies")
    few = gone.count() <= BROADCAST_KEYS
    return restored(rows.join(F.broadcast(gone) if few else gone, F.col("_key") == F.col("_gone"), "left_anti"), docs.columns)
