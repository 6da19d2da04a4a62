"""Links to a name that a third of all links have."""

from pyspark.sql import functions as F

from palimpsest.operators import links


def test_heavy_names_are_not_shuffled(spark, monkeypatch):
    rows = spark.range(6000).select(F.lit("w").alias("db_name"), F.col("id").alias("page_id"), F.timestamp_seconds(F.lit(0)).alias("ts"), F.concat(F.lit('<h1>T</h1><a href="/wiki/Hot">x</a> <a href="/wiki/P'), F.col("id") % 97, F.lit('">y</a> <a href="/wiki/Nowhere">z</a>')).alias("html"))
    pages = spark.createDataFrame([("w", 1000 + k, 0, f"P{k}") for k in range(90)] + [("w", 7, 0, "Hot"), ("w", 8, 0, "Hot")], "db_name string, page_id long, ns_id int, title string")
    names = spark.createDataFrame([("w", 0, "FIRST_LETTER", [""])], "db_name string, ns_id int, case string, all_names array<string>")
    born = spark.createDataFrame([("w", i, t) for i, t in [(7, -5), *((1000 + k, 0 if k % 2 else 5) for k in range(90))]], "db_name string, page_id long, t long").select("db_name", "page_id", F.timestamp_seconds("t").alias("ts"))
    want = {(s, 7) for s in range(6000)} | {(s, 1000 + s % 97) for s in range(6000) if s % 97 < 90}
    for heavy in (100_000, 1000, 10):
        monkeypatch.setattr(links, "HEAVY_NAME", heavy)
        found = links.extract_links(rows, pages, names)
        assert {(r.source_id, r.target_id) for r in found.collect()} == want and found.count() == len(want)
        timed = links.extract_links(rows, pages, names, born)
        assert {(r.source_id, r.target_id) for r in timed.collect()} == {(s, t) for s, t in want if t == 7 or (t - 1000) % 2}
    hot = links._resolved(links.materialise(rows.select(F.lit("Hot").alias("name"), "page_id"), "test"), spark.createDataFrame([("Hot", 7)], "name string, target_id long"), ["name"], heavy=10)
    plan = hot._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and hot.count() == 6000
    monkeypatch.setattr(links, "BROADCAST_NAMES", 0)
    assert links.extract_links(rows, pages, names).count() == len(want)
