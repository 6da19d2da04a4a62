"""The training sample of operator 3 on skewed tables."""

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language_id


def test_copies_do_not_shrink_the_sample(spark):
    hot = spark.range(20_000).select(F.lit("a hot text").alias("text"))
    texts = hot.unionByName(spark.range(50).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")))
    found = language_id.sample(texts.withColumn("lang", F.lit("en")), limit=400)
    assert sorted(found["en"]) == sorted(["a hot text", *(f"text {k}" for k in range(50))])
    few = language_id.sample(texts.withColumn("lang", F.lit("en")), limit=5)
    assert len(few["en"]) == 5 and set(few["en"]) <= set(found["en"])


def test_no_language_is_left_out(spark):
    rows = [(f"l{k:02}", f"text {k}") for k in range(65)] + [("long", "straße " * 4000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    with pytest.raises(ValueError):
        language_id.sample(df)
    found = language_id.sample(df, max_languages=66)
    assert set(found) == {lang for lang, _ in rows} and 16_000 < len(found["long"][0].encode()) <= language_id.SAMPLE_BYTES


def test_ties_and_long_texts(spark):
    """Equal code lengths go to the first language by name; a long text counts whole and its score stays below 1."""
    same = [("b", "one two three four five"), ("a", "one two three four five"), ("c", "eins zwei drei vier fünf")]
    model = language_id.train({lang: [text] for lang, text in same})
    long = "eins zwei drei " * 100_000 + "one two three four five " * 150_000
    rows = [(1, "two one"), (2, "drei vier"), (3, long), (4, None), (5, "123 !"), (1, "two one")]
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect())
    assert [(i, lang) for i, lang, _ in got] == [(1, "a"), (1, "a"), (2, "c"), (3, "a"), (4, "und"), (5, "und")]
    scores = {i: score for i, _, score in got}
    assert scores[1] == pytest.approx(0.5, abs=0.01) and 0.3 < scores[3] <= 0.5 and scores[4] == 0


def test_long_texts_give_stretches_from_anywhere(spark):
    texts = spark.range(300).select(F.lit("en").alias("lang"), F.concat(F.repeat(F.lit("a"), 30_000), F.lit("é"), F.repeat(F.lit("b"), 30_000), F.col("id").cast("string")).alias("text"))
    found = language_id.sample(texts)["en"]
    assert found == language_id.sample(texts.repartition(5))["en"] and all(0 < len(t.encode()) <= language_id.SAMPLE_BYTES for t in found)
    assert sum("a" in t for t in found) > 60 and sum("b" in t for t in found) > 60
