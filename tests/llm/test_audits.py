"""Filter audit, decontamination and whitening against brute force, with hard rows."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, filter_audit, whitening

WORDS = "the of and river stone cloud über straße niño que la ciel tree paper lamp garden mountain quick silver 12 a1".split()


def prose(n, seed, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def clashing(df):
    for name in ("part", "mask", "digest", "_first", "n", "sums", "good", "toxic", "words", "item", "window", "x", "node", "spans", "items", "a.b", "text_key"):
        df = df.withColumn(name, F.lit(1))
    return df.repartition(3)


# Filter audit

AUDITED = [
    (1, "", "s1"), (2, None, "s1"), (3, prose(250, 1), "s1"), (4, prose(250, 1), "s2"), (5, prose(250, 1), None), (6, prose(250, 1), ""), (6, prose(250, 1), "s1"), (7, "AB c $ " * 300, "s1"),
    (8, "ABC", "s2"), (9, "word x\x85y " * 210, "s2"), (None, prose(250, 1), "s1"), (None, "lone", "s3"), (10, " ".join(f"w{i}" for i in range(60_000)), "s2"), (11, "w" * 200_000, "s2"), (3, prose(250, 1), "s1"),
]
LABELS = [(1, 1, 0), (3, 1, 1), (4, 0, 1), (4, 1, 0), (7, None, 1), (99, 1, 1), (None, 1, 1), (8, 1, None)]


def audited(rows, labels):
    masks = []
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any((t or "") == text and None not in (i, doc_id) and i < doc_id for i, t, _ in rows)
        failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller}
        own = [x for x in labels if doc_id is not None and x[0] == doc_id]
        masks.append((source or "", {k for k, v in failed.items() if v}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    want, value = {}, Counter()
    for part in {m[0] for m in masks}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                c = Counter()
                for _, failed, good, toxic in (m for m in masks if m[0] == part):
                    before, own = failed & set(order[: step - 1]), letter in failed
                    c["kept"] += not before and not own
                    c["removed"] += own and not before
                    c["redundant"] += own and bool(before)
                    c["unique_fails"] += failed == {letter}
                    c["good_lost"] += own and not before and good
                    c["toxic_lost"] += own and not before and toxic
                value[part, letter] += c["removed"]
                want[part, order, step] = c
    return {k: (*(int(c[x]) for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), value[k[0], k[1][k[2] - 1]]) for k, c in want.items()}


def test_filter_audit(spark):
    docs = clashing(spark.createDataFrame(AUDITED, "doc_id long, text string, source string"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(docs, labels)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {tuple(r[:3]): tuple(r[3:]) for r in out.collect()}
    assert got == audited(AUDITED, LABELS)
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    assert filter_audit.audit(docs, labels.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_masks_come_back_from_their_parities(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("p"), F.col("id") % 3).alias("part"), (F.xxhash64("id") % 32 + 31).cast("int").bitwiseAND(31).alias("mask"), (F.col("id") % 5 == 0).alias("good"), F.lit(False).alias("toxic"))
    got = {(r.part, r.good, r.mask): r.n for r in filter_audit.mask_cells(filter_audit.parity_sums(rows)).collect() if r.n}
    assert got == {(r.part, r.good, r.mask): r["count"] for r in rows.groupBy("part", "good", "mask").count().collect()}


# Decontamination

ITEMS = [(1, prose(25, 5)), (2, prose(10, 6)), (10, "Über-Straße 12; a1?"), (3, None), (4, " -- "), (5, prose(12, 7) + " " + prose(12, 5)), (7, "lamp"), (8, prose(25, 5)), (None, "silver silver silver")]
PASSAGE = prose(25, 5).split()
CAPITALS = re.sub("[a-z]", lambda m: m[0].upper(), ", ".join(PASSAGE[3:18]))
TEXTS = [
    (1, None), (2, ""), (3, "?! \n"), (4, "Some words, " + CAPITALS + "!\nEnd"), (5, " ".join(PASSAGE[:9])), (6, "ÜBER über-STRASSE über straße 12 A1 x"), (6, "ÜBER über-STRASSE über straße 12 A1 x"), (None, prose(10, 6)),
    (8, prose(30_000, 9) + " " + prose(12, 7) + " " + prose(12, 5)), (9, "lamp" * 3), (10, "lamp lamp 😀lamp lamp"), (11, " ".join(PASSAGE[:12] + PASSAGE[:12])), (12, "x\x00lamp\x7flamp"), (13, "silver " * 5), (None, prose(10, 6)),
]


def leaked(texts, items, size=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    found = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found[tuple(w[i : i + size])].add("" if item is None else str(item))
    out = []
    for doc_id, text in texts:
        w, hit, own = words(text), set(), set()
        for window, ids in found.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    own |= ids
        out.append((doc_id, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    return clashing(spark.createDataFrame(TEXTS, "doc_id long, text string"))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def _key(row):
    return str(row)


def test_decontamination(spark, texts, items):
    got = [tuple(r)[:6] for r in decontamination.report(texts, items).collect()]
    assert sorted(got, key=_key) == sorted(leaked(TEXTS, ITEMS), key=_key)
    assert [tuple(r)[1:6] for r in decontamination.report(texts, items.where("false")).collect() if r.n_hit or r.n_items or r.contaminated] == []
    assert decontamination.report(texts.where("false"), items).count() == 0


def test_many_blocks_find_the_same(texts, items):
    one, many = (sorted(map(str, decontamination.leaks(texts, items, block=b).collect())) for b in (decontamination.BLOCK, 9))
    assert one == many
    kept = [sorted(str(r.doc_id) for r in decontamination.without_leaks(texts, items, block=b).collect()) for b in (decontamination.BLOCK, 9)]
    assert kept[0] == kept[1] == sorted(str(r[0]) for r in leaked(TEXTS, ITEMS) if not r[5])
    assert decontamination.without_leaks(texts, items).columns == texts.columns


def test_spans_are_places_of_the_original(texts, items):
    by_id = dict(TEXTS)
    for r in decontamination.leaks(texts, items).where("doc_id IS NOT NULL").collect():
        words = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", by_id[r.doc_id] or ""))
        for s in r.spans:
            assert (words[s.first_word].start(), words[s.end_word - 1].end()) == (s.start, s.end)
    four = decontamination.leaks(texts, items).where("doc_id = 4").first()
    assert [by_id[4][s.start : s.end] for s in four.spans] == [CAPITALS]


# Whitening


def _vectors(n=700, d=40, seed=3):
    r = np.random.default_rng(seed)
    mixed = r.normal(size=(n, d)) @ r.normal(size=(d, d)) * 0.3 + r.normal(size=d)
    return mixed.astype(np.float32)


def test_whitening(spark):
    v = _vectors()
    bad = [(900, None), (901, [1.0] * 39 + [None]), (902, [float("nan")] + [1.0] * 39), (903, [float("inf")] * 40), (904, [-float("inf")] + [0.0] * 39), (905, [])]
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)] + [(None, [float(c) for c in v[0]]), (5, [float(c) for c in v[5]])]
    table = clashing(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")).repartition(20)
    out = whitening.whiten(table)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.toPandas()
    x = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n = len(x)
    assert len(got) == n * 32 and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    centred = x - x.sum(axis=0) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    share = values / np.trace(centred.T @ centred / n)
    want = centred @ axes / np.sqrt(values)
    whole = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0), strict=True)) for row in x]
    for i in (0, 1, 37, 699):
        own = got[got.vec_id == i].sort_values("component")
        if i == 5:
            continue
        assert set(own.deviation) == {whole[i]}
        np.testing.assert_allclose(own.explained, share, rtol=1e-9)
        np.testing.assert_allclose(np.abs(own.whitened), np.abs(want[i]), atol=1e-6)
    for k in range(32):  # one sign for all rows
        mine = got[(got.component == k + 1) & got.vec_id.notna()].drop_duplicates("vec_id").sort_values("vec_id").whitened.to_numpy()
        assert abs(abs(np.dot(mine, want[:700, k])) / np.dot(want[:700, k], want[:700, k]) - 1) < 1e-6


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert out.count() == 0 and out.columns[0] == "vec_id"


def test_directions_without_variance_are_left_out(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), float(i * i % 11)]) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(30)).toPandas()
    assert set(got.component) == {1, 2} and got.identity_error[0] < 1e-9


def test_errors(spark):
    with pytest.raises(ValueError, match="dimensions"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))
