"""The near-copy stage against all pairs in plain Python."""

import collections
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from palimpsest import storage
from palimpsest.llm import rare_shingles, simhash
from tests.llm.test_operators import prose


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in simhash.drop_near_copies(df).collect()}


def shingle_sets(texts):
    return [{int(x) for x in simhash.hashes(t, 5)} for t in texts]


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def edited(words, places, mark):
    return " ".join(f"{mark}{i}" if i in places else w for i, w in enumerate(words))


def outside(a, b):
    """Whether two texts are too far apart for the fingerprint search."""
    x = (simhash.fingerprint(simhash.hashes(a, 2)) ^ simhash.fingerprint(simhash.hashes(b, 2))) & ((1 << 64) - 1)
    return x.bit_count() > 10 or all((x >> low & ((1 << n) - 1)).bit_count() > 1 for low, n in simhash.segment_bounds(3))


def test_pairs_outside_the_fingerprint_search_go(spark):
    r, texts = random.Random(3), []
    for k in range(400):
        words = prose(80, 9000 + k).split(" ")
        copy = edited(words, {r.randrange(4), r.randrange(76, 80)}, f"new{k}x")
        if outside(" ".join(words), copy) and similar(*shingle_sets([" ".join(words), copy])):
            texts += [" ".join(words), copy]
    assert len(texts) >= 6
    assert kept(spark, texts) == set(range(0, len(texts), 2))


def test_one_of_each_group_stays(spark):
    """Edits of a later original are similar to it, but not to each other."""
    words = prose(200, 31).split(" ")
    star = [edited(words, {10 + 12 * k, 14 + 12 * k, 18 + 12 * k}, f"new{k}x") for k in range(6)]
    texts = [*star, " ".join(words), prose(200, 32)]
    sets = shingle_sets(texts)
    assert all(similar(sets[k], sets[6]) for k in range(6)) and not any(similar(sets[a], sets[b]) for a in range(6) for b in range(a))
    assert kept(spark, texts) == {0, 7}


def test_rows_that_share_an_id(spark):
    a, b, c, d = (prose(60, 700 + k) for k in range(4))
    rows = [(1, a), (2, a + " word"), (2, b), (3, c), (3, c), (None, d), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit(1)).withColumn("id", F.lit(2)).repartition(3)
    out = simhash.drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id is None, r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(False, 1, a), (False, 2, b), (False, 3, c), (True, None, d)], key=str)


def test_intermediate_tables_go(spark):
    """Fingerprints, first shingles, sets and links are deleted; what names the rows to drop stays until the end."""
    before = {path for _, path, *_ in storage._written}
    words = prose(80, 12).split(" ")
    df = spark.createDataFrame([(1, " ".join(words)), (2, edited(words, {0}, "new")), (3, prose(80, 13))], "doc_id long, text string")
    out = simhash.drop_near_copies(df)
    left = [path for _, path, *_ in storage._written if path not in before]
    assert len(left) == 1 and "near-copies" in left[0]
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert not glob.glob(f"{storage.shared_dir(spark).removeprefix('file://')}/palimpsest-near-sets-*")


SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(SF), reason="no driver tables")
def test_no_similar_pair_is_left_in_the_tables(spark):
    """All pairs of the whole table by an inverted index: each has one document left at most, and every component one."""
    docs = spark.read.parquet(SF)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sets, holders, together = dict(zip(texts, shingle_sets(texts.values()), strict=True)), collections.defaultdict(list), collections.Counter()
    for i, found in sets.items():
        for x in found:
            holders[x].append(i)
    for found in holders.values():
        together.update((a, b) for a in found for b in found if a < b)
    root = {i: i for i in texts}
    empty = sorted(i for i, found in sets.items() if not found)
    for a, b in [*((a, b) for (a, b), n in together.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)), *((empty[0], x) for x in empty[1:])]:
        if root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if x == high else x for i, x in root.items()}
    assert len(set(root.values())) < len(texts)
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == set(root.values())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_balls_of_fingerprints_are_not_broadcast(spark):
    """Spark takes an exploded table for as large as its file, which is far below its limit for broadcasts."""
    distinct = storage.materialise(spark.createDataFrame([(i * 7,) for i in range(100)], "fp long"), "few-fingerprints")
    assert "Broadcast" not in plan_of(simhash.links(distinct))


def test_probes_and_shared_shingles_are_not_broadcast(spark):
    rows = [(i, i * 7, 10) for i in range(100)]
    nodes = storage.materialise(spark.createDataFrame(rows, "doc_id long, fp long, n long"), "few-nodes")
    assert "Broadcast" not in plan_of(simhash._met(simhash._probes(nodes), simhash._table(nodes), F.col("b") < F.col("a")))
    schema = "doc_id long, root long, place int, shingle long, before array<long>, n long, sketch0 long, sketch1 long, sketch2 long, sketch3 long"
    shared = storage.materialise(spark.createDataFrame([(i, i, 0, i % 9, [], 10, 0, 0, 0, 0) for i in range(100)], schema), "few-shingles")
    assert "Broadcast" not in plan_of(rare_shingles.meetings(shared, 0.8, F.lit(True)))
