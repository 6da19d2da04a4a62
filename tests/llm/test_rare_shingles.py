"""Crowds of documents that resemble each other, against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import rare_shingles, simhash
from tests.llm.test_operators import prose


def crowd():
    """Variants of one text, some of them similar to each other, with repeats and wordless texts."""
    r, base = random.Random(5), prose(150, 77).split(" ")
    texts = []
    for k in range(60):
        words = list(base)
        for at in r.sample(range(len(words)), k % 12):
            words[at] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(words))
    return [*texts, texts[3], "", " ", "two words"]


def sets_of(texts):
    return [{int(x) for x in simhash.hashes(t, 5)} for t in texts]


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_first_shingles():
    counts = np.zeros(rare_shingles.COUNTERS, dtype=np.int64)
    found = np.arange(1, 36, dtype=np.uint64)
    counts[1:31] = 9
    assert rare_shingles.first_shingles(found, counts, 0.8).tolist() == [31, 32, 33, 34, 35, 1, 2, 3]
    assert rare_shingles.first_shingles(found[:0], counts, 0.8).tolist() == [0]


def test_rare_pairs_lose_nothing(spark):
    texts = crowd()
    sets = sets_of(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = rare_shingles.rare_pairs(df, lambda t: simhash.hashes(t, 5), lambda t: 0, 0.8, F.lit(True))
    pairs = {(r.a, r.b) for r in found.collect()}
    wanted = {(a, b) for a in range(len(texts)) for b in range(a) if similar(sets[a], sets[b])}
    assert wanted <= pairs and all(b < a for a, b in pairs)
    assert rare_shingles.rare_pairs(df.limit(0), lambda t: simhash.hashes(t, 5), lambda t: 0, 0.8, F.lit(True)).count() == 0


def test_crowds_leave_one_of_each_component(spark):
    texts = crowd()
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.drop_near_copies(df).collect()}
    sets, root = sets_of(texts), list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if similar(sets[a], sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert kept == set(root)


def test_pairs_are_not_listed_at_every_shingle(spark, monkeypatch):
    """A text and its 30 variants have many first shingles in common; each pair is met about once."""
    base, met, real = prose(300, 78).split(" "), [], rare_shingles.meetings

    def counted(*args):
        met.append(real(*args).count())
        return real(*args)

    monkeypatch.setattr(rare_shingles, "meetings", counted)
    texts = [" ".join(f"new{k}" if i == 5 * k else w for i, w in enumerate(base)) for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pairs = [(r.a, r.b) for r in rare_shingles.rare_pairs(df, lambda t: simhash.hashes(t, 5), lambda t: 0, 0.8, F.lit(True)).collect()]
    assert sorted(pairs) == [(a, b) for a in range(30) for b in range(a)]
    assert met[0] < 2 * len(pairs)


def test_long_texts_that_only_share_a_passage_are_no_candidates(spark):
    passage = " ".join(f"rare{i}" for i in range(40))
    texts = [f"{passage} {' '.join(f'w{k}x{i}' for i in range(3000))}" for k in range(2)]
    df = spark.createDataFrame([*enumerate(texts), (2, texts[1] + " more")], "doc_id long, text string")
    found = rare_shingles.rare_pairs(df, lambda t: simhash.hashes(t, 5), lambda t: 0, 0.8, F.lit(True))
    assert [(r.a, r.b) for r in found.collect()] == [(2, 1)]


def test_sketches_of_unlike_lengths(spark):
    """Bins that differ are at most the hashes that only one set has, also where one sketch is twice as long; null beyond that."""
    r = np.random.default_rng(4)
    found = np.unique(r.integers(0, 1 << 63, 1100).astype(np.uint64))
    cases = [(found[:1020], found[:1030]), (found[:1020], found[20:1030]), (found[:0], found[:10]), (found[:500], found[:1100])]
    assert [len(rare_shingles.sketch(x)) for x in (found[:0], found[:257], found[:1024], found[:1025])] == [4, 8, 16, 32]
    rows = [(rare_shingles.sketch(a).tolist(), rare_shingles.sketch(b).tolist()) for a, b in cases]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = [x.d for x in df.select(rare_shingles.sketches_apart(F.col("a"), F.col("b")).alias("d")).collect()]
    most = [len(np.setxor1d(a, b)) for a, b in cases]
    assert all(d <= m and (m - d) % 2 == 0 for d, m in zip(got[:3], most[:3], strict=True)) and got[0] > 0 and got[3] is None
