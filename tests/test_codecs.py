from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import codecs as C


@settings(max_examples=60, deadline=None)
@given(st.text(), st.text())
def test_edits_round_trip(old, new):
    assert C.edited(old, C.edits(old, new)) == new


@given(st.text())
def test_codecs_round_trip(text):
    for codec in C.CODECS:
        assert C.unpacked(C.packed(text, codec), codec) == text


def history(spark):
    rows = [(p, r, r, None if (p, r) == (2, 3) else f"page {p}\n" + "\n".join(f"line {i * (1 + (i + r) % 7 == 0)}" for i in range(r + 3))) for p, n in ((1, 120), (2, 5), (3, 1)) for r in range(1, n + 1)]
    return spark.createDataFrame(rows, "page_id long, revision_id long, ts long, text string")


def test_delta_chains(spark):
    source = history(spark)
    stored = C.compress_history(source).cache()
    codecs = {(r.page_id, r.revision_id): r.codec for r in stored.collect()}
    assert [r for (p, r), c in sorted(codecs.items()) if p == 1 and c == "BZIP2"] == [1, 51, 101, 120]
    assert codecs[2, 3] is None and codecs[2, 4] == "BZIP2" and codecs[3, 1] == "BZIP2"
    decoded = C.decode_history(stored)
    assert decoded.where("text_error").count() == 0
    assert decoded.select(source.columns).exceptAll(source).count() == 0 and decoded.count() == source.count()


def test_lost_base(spark):
    stored = C.compress_history(history(spark)).where("not (page_id = 1 and revision_id = 51)")
    lost = C.decode_history(stored).where("page_id = 1 and revision_id between 50 and 102")
    found = {r.revision_id: (r.text, r.text_error) for r in lost.collect()}
    assert found[50][0] is not None and found[101][0] is not None
    assert all(found[r] == (None, True) for r in range(52, 101))


def test_columns(spark):
    df = spark.createDataFrame([("äx",), ("",), (None,)], "text string")
    for codec in C.CODECS:
        packed = df.withColumn("data", C.compress(F.col("text"), codec))
        got = packed.withColumn("back", C.uncompress(F.col("data"), F.lit(codec))).collect()
        assert all(r.back == r.text for r in got)


def test_edits_of_long_texts():
    lines = [f"line {i}\n" if i % 3 else "\n" for i in range(4000)]
    old, new = "".join(lines), "".join(lines[:1000] + ["added\n"] + lines[1200:3000] + ["\n"] * 50 + lines[2500:])
    for a, b in ((old, new), (new, old), (old, ""), ("", old), (old, old), ("\n" * 60_000, "\n" * 50_000 + "x"), ("x" + "|\n" * 40_000 + "y", "z" + "|\n" * 39_000 + "w")):
        delta = C.edits(a, b)
        assert C.edited(a, delta) == b
    assert len(C.edits(old, new)) < len(C.packed(new, "BZIP2")) / 4


def test_crowded_chains(spark, monkeypatch):
    from palimpsest.operators import history as H

    source = history(spark)
    monkeypatch.setattr(H, "WINDOW_ROWS", 10)
    stored = C.compress_history(source).cache()
    assert [r.revision_id for r in stored.where("page_id = 1 and codec = 'BZIP2'").sort("revision_id").collect()] == [1, 51, 101, 120]
    decoded = C.decode_history(stored.where("not (page_id = 1 and revision_id in (1, 51))"))
    found = {(r.page_id, r.revision_id): (r.text, r.text_error) for r in decoded.collect()}
    want = {(r.page_id, r.revision_id): r.text for r in source.collect()}
    assert all(found[k] == ((None, True) if k[0] == 1 and k[1] < 101 else (want[k], False)) for k in found) and len(found) == len(want) - 2
    assert C.decode_history(C.compress_history(source)).select(source.columns).exceptAll(source).count() == 0


def test_rendered_chains(spark):
    rows = [(1, r, r, None if r == 4 else f"<p>{r}</p>") for r in range(1, 8)]
    stored = C.compress_rendered(spark.createDataFrame(rows, "page_id long, revision_id long, ts long, html string"), interval=3).cache()
    assert {r.revision_id: (r.codec, r.html_error) for r in stored.collect()} == {1: ("BZIP2", False), 2: (C.DELTA, False), 3: (C.DELTA, False), 4: (None, True), 5: ("BZIP2", False), 6: (C.DELTA, False), 7: ("BZIP2", False)}
    assert {r.revision_id: r.html for r in C.decode_history(stored, "html").collect()} == {r[1]: r[3] for r in rows}


def test_tier_attributes(spark):
    from palimpsest.operators import tiers
    from palimpsest.storage import materialise

    values = spark.createDataFrame([(p, t, f"page {p} at {t}") for p in (1, 2) for t in range(6)], "page_id long, t long, value string").select("page_id", F.timestamp_seconds("t").alias("ts"), "value")
    stored = materialise(tiers.encoded(values, C.DELTA), "test")
    new = values.where("page_id = 1 and unix_seconds(ts) in (2, 3)").withColumn("value", F.when(F.unix_seconds("ts") == 2, "other"))
    for codec in (C.DELTA, "GZIP"):
        after = materialise(tiers.set_attribute(stored, new, codec), "test")
        got = {(r.page_id, r.ts.second): (r.value, r.value_error) for r in tiers.attribute(after).collect()}
        want = {(p, t): (f"page {p} at {t}", False) for p in (1, 2) for t in range(6) if (p, t) != (1, 3)} | {(1, 2): ("other", False)}
        assert got == want
    assert [r.ts.second for r in tiers.ordered_tiers(stored).where("page_id = 2").collect()] == list(range(6))
    assert stored.where(tiers.has_attribute(F.col("data"))).count() == 12


def test_attribute_chains_that_are_not_touched_stay(spark):
    from palimpsest.operators import tiers
    from palimpsest.storage import materialise

    at = F.timestamp_seconds(F.col("t")).alias("ts")
    base = spark.range(0, 180).select(F.lit(1).cast("long").alias("page_id"), (F.col("id") * 10).alias("t"), F.concat(F.lit("value "), F.col("id")).alias("value")).select("page_id", at, "value")
    stored = materialise(tiers.encoded(base, C.DELTA), "test")
    new = spark.createDataFrame([(1, 555, "between"), (1, 600, None), (1, 5000, "behind"), (1, -5, "before"), (9, 3, "new page"), (9, 4, None)], "page_id long, t long, value string").select("page_id", at, "value")
    after = materialise(tiers.set_attribute(stored, new), "test")
    rows = lambda df: {(r.page_id, r.ts): (r.codec, r.data, r.base_id) for r in df.collect()}
    before, now = rows(stored), rows(after)
    changed = {k for k in before if now.get(k) != before[k]}
    # Frames are at 0, 500, 1000, 1500 and 1790 seconds: the first chain grows beyond its interval, the second loses a tier, the others stay.
    assert {k[1].timestamp() for k in changed} <= {0, 490, 560, 600, 610, 1790}
    assert all(before[k] == now[k] for k in before if 1000 <= k[1].timestamp() < 1790)
    got = {(r.page_id, int(r.ts.timestamp())): (r.value, r.value_error) for r in tiers.attribute(after).collect()}
    want = {(1, 10 * i): (f"value {i}", False) for i in range(180) if i != 60} | {(1, 555): ("between", False), (1, 5000): ("behind", False), (1, -5): ("before", False), (9, 3): ("new page", False)}
    assert got == want
    assert after.groupBy("page_id").agg(F.max_by("codec", "ts").alias("c")).where("c = 'BZIP2'").count() == 2


def test_repeated_revisions_are_stored_once(spark, monkeypatch):
    from palimpsest.operators import history as H

    source = history(spark)
    again = source.unionByName(source.where("revision_id % 3 = 0")).unionByName(source.where("revision_id = 2 AND page_id = 1").withColumn("text", F.lit("other"))).repartition(5)
    for limit in (200_000, 10):
        monkeypatch.setattr(H, "WINDOW_ROWS", limit)
        decoded = C.decode_history(C.compress_history(again)).cache()
        assert decoded.count() == source.count() and decoded.where("text_error").count() == 0
        assert decoded.where("NOT (page_id = 1 AND revision_id = 2)").select(source.columns).exceptAll(source).count() == 0


def test_edits_inside_long_lines():
    import random

    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(3000)]
    old = [r.choice(words) for _ in range(30_000)]
    new = list(old)
    for at in (5, 9_000, 9_001, 20_000):
        new[at] = "changed"
    del new[15_000:15_010]
    a, b = " ".join(old), " ".join(new)
    delta = C.edits(a, b)
    assert C.edited(a, delta) == b and len(delta) < 500
    cjk = "".join(r.choices("的一是了我不人在他有这个上们来到时大地为子中你说生国年着就那和要她出也得里后自以会", k=40_000))
    changed = cjk[:10_000] + "变化" + cjk[10_000:30_000] + cjk[30_050:]
    delta = C.edits(cjk, changed)
    assert C.edited(cjk, delta) == changed and len(delta) < 2_000
    rubbish = "".join(r.choices("abc \n", k=60_000)), "".join(r.choices("abc \n", k=60_000))
    assert C.edited(rubbish[0], C.edits(*rubbish)) == rubbish[1]


def test_reads_of_chosen_revisions(spark, tmp_path):
    from palimpsest.operators import history as H
    from palimpsest.sources import delta_store

    rows = spark.range(0, 40 * 120).select((F.col("id") % 40).alias("page_id"), F.col("id").alias("revision_id"), (F.col("id") * 7 % 4801).alias("ts"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    delta_store.write(rows, str(tmp_path), buckets=8)
    wanted = spark.createDataFrame([(3, 3), (3, 4763), (17, 1017), (17, 99_999), (99, 3)], "page_id long, revision_id long")
    got = {(r.page_id, r.revision_id): (r.text, r.text_error) for r in delta_store.read(spark, str(tmp_path), wanted, buckets=8).collect()}
    assert got == {(p, i): (f"text {i}", False) for p, i in ((3, 3), (3, 4763), (17, 1017))}
    found, needed = delta_store.chains_of(spark, str(tmp_path), wanted, buckets=8)
    place = {r.revision_id: r.place for r in found.collect()}
    assert needed.count() == len({r.chain for r in found.collect()}) + sum(max(r["p"] for r in found.where(f"chain = {c}").selectExpr("place AS p").collect()) for c in {r.chain for r in found.collect()}) and len(place) == 3
    every = spark.read.parquet(f"{tmp_path}/chains")
    near = delta_store._within(every, "bucket", found, ("page_id",))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "GreaterThanOrEqual(page_id,3)" in plan and "LessThanOrEqual(page_id,17)" in plan
    assert 0 < near.select(F.input_file_name()).distinct().count() <= 3 < every.select(F.input_file_name()).distinct().count()
    starts = spark.createDataFrame([(5, 4805 - 40)], "page_id long, revision_id long")
    later = H.sequence_from(delta_store.index(spark, str(tmp_path)).select("page_id", "revision_id", "ts"), starts)
    texts = delta_store.read(spark, str(tmp_path), later, buckets=8)
    assert texts.count() == later.count() > 0 and texts.where("text_error OR text <> concat('text ', revision_id)").count() == 0
    assert delta_store.read(spark, str(tmp_path), wanted.where("false"), buckets=8).count() == 0
