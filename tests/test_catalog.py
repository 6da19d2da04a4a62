"""Imports that fail, race or repeat, and reads that open only what they need."""

import pytest
from pyspark.sql import functions as F

from palimpsest.sources.catalog import Catalog


def pages(spark, ids, db="w"):
    return spark.createDataFrame([(db, i, 0, f"T{i}") for i in ids], "db_name string, page_id long, ns_id int, title string")


def ids(catalog):
    return sorted(r.page_id for r in catalog.read("page").collect())


def test_an_import_that_is_killed_leaves_nothing(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, str(tmp_path))
    catalog.add("page", pages(spark, range(5)))
    with monkeypatch.context() as m:
        m.setattr(Catalog, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            catalog.add_all({"page": pages(spark, range(3, 9)), "contributor": spark.createDataFrame([("w", 1, "a")], "db_name string, contributor_id long, name string")})
    again = Catalog(spark, str(tmp_path))
    assert ids(again) == list(range(5)) and again.read("contributor").count() == 0
    with monkeypatch.context() as m:  # dies while it writes the second table
        write = Catalog._write
        m.setattr(Catalog, "_write", lambda self, name, rows: write(self, name, rows) if name == "page" else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            again.add_all({"page": pages(spark, range(3, 9)), "contributor": spark.createDataFrame([("w", 1, "a")], "db_name string, contributor_id long, name string")})
    assert ids(again) == list(range(5))
    for _ in range(2):
        again.add_all({"page": pages(spark, range(3, 9)), "contributor": spark.createDataFrame([("w", 1, "a")], "db_name string, contributor_id long, name string")})
    assert ids(again) == list(range(9)) == ids(catalog) and catalog.read("contributor").count() == 1 and len(catalog.log()) == 2


def test_imports_at_the_same_time_lose_and_double_nothing(spark, tmp_path, monkeypatch):
    one, other = Catalog(spark, str(tmp_path)), Catalog(spark, str(tmp_path))
    commit, raced = Catalog._commit, []

    def late(self, number, entry):
        if self is one and not raced:
            raced.append(number)
            other.add("page", pages(spark, range(4, 12)))
        return commit(self, number, entry)

    monkeypatch.setattr(Catalog, "_commit", late)
    one.add("page", pages(spark, range(8)))
    assert raced == [0] and ids(one) == ids(other) == list(range(12)) and sorted(one.log()) == [0, 1]
    assert len(list((tmp_path / "page").iterdir())) == 2  # what lost the race is gone


def test_usage_rows_repeat_as_often_as_an_import_has_them(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    rows = [("w", 1, "Q1", "S")] * 3 + [("w", 1, "Q2", None)] * 2 + [(None, None, None, None)] * 2
    usage = lambda r: spark.createDataFrame(r, "db_name string, page_id long, entity_id string, aspect string")
    for part in (rows[:2], rows, rows, [("w", 2, "Q1", "S")]):
        catalog.add("entity_usage", usage(part))
    assert sorted(map(tuple, catalog.read("entity_usage").collect()), key=str) == sorted([*rows, ("w", 2, "Q1", "S")], key=str)


def test_null_keys_are_known_again(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    for _ in range(2):
        catalog.add("page", pages(spark, [1]).unionByName(spark.createDataFrame([(None, None, None, None)], "db_name string, page_id long, ns_id int, title string")))
    assert catalog.read("page").count() == 2


def test_revisions_are_known_by_id_whatever_their_page(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    for page in (1, 2):
        catalog.add("revision", spark.range(5).select(F.lit("w").alias("db_name"), F.col("id").alias("revision_id"), F.lit(page).alias("page_id"), *[F.lit(None).alias(c) for c in ("parent_id", "ts", "tz", "contributor_id", "ip", "comment", "minor", "sha1", "model", "format", "bytes", "text")]))
    assert catalog.read("revision").groupBy("page_id").count().collect() == [(1, 5)]


def files(df):
    return df.select(F.input_file_name().alias("f")).distinct().count()


def test_reads_open_only_what_they_need(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path), buckets=8)
    links = spark.range(4000).select(F.lit("w").alias("db_name"), (F.col("id") % 400).alias("source_id"), F.col("id").alias("target_id"), F.lit("ARTICLE").alias("link_type"), F.timestamp_seconds((F.col("id") % 3) * 86400).alias("ts"))
    catalog.add("link", links)
    layer = catalog.read("link", layer="1970-01-02 00:00:00")
    some = catalog.read("link", layer="1970-01-02 00:00:00", ids=[7, 11])
    assert layer.count() == 1333
    assert some.count() == links.where("source_id IN (7, 11) AND ts = timestamp'1970-01-02 00:00:00'").count() > 0
    every = catalog.read("link")
    assert every.count() == 4000 and files(every) >= 24
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "layer" in plan.split("PartitionFilters: [")[1].split("]")[0] and "bucket" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert files(some) <= 2 and files(layer) <= files(every) / 3
    many = catalog.read("link", ids=range(3000))
    assert many.count() == 4000
    assert catalog.read("link", ids=[]).count() == 0 and catalog.read("link", ids=[None, 7]).count() == 10
    catalog.add("page", pages(spark, [1]))
    with pytest.raises(ValueError):
        catalog.read("page", layer="1970-01-02")
    other = Catalog(spark, str(tmp_path), buckets=3)  # the catalog's own number counts
    assert other.read("link", ids=[7]).count() == 10
