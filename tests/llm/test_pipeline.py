"""The pipeline on a small corpus against plain Python, stage by stage."""

import collections
import random

import corpus_pipeline
import pytest

from tests.llm.test_operators import WORD_FILE, brute_quality, brute_spans, check_packing, norm, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    texts = [prose(120 + k, 1000 + k) for k in range(40)]
    texts += [texts[k] for k in range(5)] + [texts[k].replace(" ", "  ", 2) for k in range(5, 8)]
    for k in range(10, 16):
        words = texts[k].split(" ")
        words[50] = "changed"
        texts.append(" ".join(words))
    texts += ["too short", "", None, "%% ## ** " * 60, prose(80, 5000) + " write to me@mail.org now"]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = [(i, texts[k], "en", f"s{k % 3}", len(texts[k] or "")) for i, k in enumerate(order)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    return str(folder), {r[0]: r[1] for r in rows}


def test_stages(spark, corpus):
    folder, texts = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == columns
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    good = kept["quality_rules"]
    assert {i for i, t in texts.items() if not brute_quality(t)[-1] and "%%" not in (t or "")} == set(good)
    first = {}
    for i in sorted(good):
        first.setdefault(norm(good[i]), i)
    assert set(kept["exact_dedup"]) == set(first.values())
    grams = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in kept["exact_dedup"].items()}
    similar = lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    near = kept["near_dedup"]
    assert set(near) == {i for i in grams if not any(similar(i, j) for j in grams if j < i)} and len(near) == len(grams) - 6
    for i, text in kept["pii"].items():
        assert text == near[i] if not brute_spans(near[i]) else "[EMAIL]" in text and "@" not in text
    rows = [r.asDict() for r in docs.collect()]
    used = check_packing(rows, list(kept["pii"].items()), 2048)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_run(spark, corpus):
    folder, _ = corpus
    rows = corpus_pipeline.run(spark, folder).collect()
    counts = collections.Counter(r.doc_id for r in rows)
    assert rows and max(counts.values()) == 1 and all(len(r.ids) == r.length for r in rows)


def test_hard_tables(spark, corpus, tmp_path):
    """An empty table, and one with null and repeated ids and columns whose names the stages use themselves."""
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    odd = docs.unionByName(docs.limit(3)).unionByName(docs.where("length(text) > 500").limit(1).selectExpr("cast(null as bigint) as doc_id", "concat('x ', text) as text", "lang", "source", "n_chars"))
    for name in ("_key", "key", "row", "_row", "norm", "digest", "kept", "id", "part", "length"):
        odd = odd.withColumn(name, odd["doc_id"] % 2)
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    plain, rows = (corpus_pipeline.run(spark, path).collect() for path in (folder, f"{tmp_path}/odd"))
    assert sorted((r.doc_id, r.ids_crc32) for r in rows if r.doc_id is not None) == sorted((r.doc_id, r.ids_crc32) for r in plain)
