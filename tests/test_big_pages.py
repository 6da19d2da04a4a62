"""Dumps whose pages are larger than a split."""

import bz2
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import xml_dump

SITE = '<mediawiki><siteinfo><sitename>W</sitename><dbname>w</dbname><base>https://w.example.org/wiki/Main</base><generator>g</generator><case>first-letter</case><namespaces><namespace key="0" case="first-letter"/></namespaces></siteinfo>\n'


def page(number, revisions, title=None):
    seeds = [random.Random(i) for i in revisions]
    body = "".join(
        f"<revision>\n<id>{i}</id><timestamp>2004-01-01T00:00:{i % 60:02}Z</timestamp><contributor><username>U{i % 3}</username><id>{i % 3 + 1}</id></contributor>"
        f"<model>wikitext</model><format>text/x-wiki</format><text xml:space=\"preserve\">é &lt;page&gt; {i} {''.join(chr(97 + r.randrange(26)) for _ in range(900))}</text></revision>\n"
        for i, r in zip(revisions, seeds, strict=True)
    )
    return f"<page>\n<title>{title or f'P &amp; {number}'}</title><ns>0</ns><id>{number}</id><redirect title=\"x\" />\n{body}</page>\n"


def dump(first):
    return SITE + page(first, [first * 10_000]) + page(first + 1, []) + page(first + 2, range(first * 10_000 + 1, first * 10_000 + 1500)) + page(first + 3, [first * 10_000 + 2000]) + page(first + 4, []) + "</mediawiki>"


@pytest.mark.parametrize("suffix", ["", ".bz2", ".gz"])
def test_a_page_over_many_splits(spark, tmp_path, suffix):
    import gzip

    pack = {"": bytes, ".bz2": lambda x: bz2.compress(x, 1), ".gz": gzip.compress}[suffix]
    for first in (1, 11):
        (tmp_path / f"dump-{first}.xml{suffix}").write_bytes(pack(dump(first).encode()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        records = xml_dump._records(spark, str(tmp_path))
        n = records.select("file", "split").distinct().count()
        assert n > 40 if suffix == "" else n > 2 if suffix == ".bz2" else n == 2
        for staged in (False, True):
            tables = xml_dump.read_dump(spark, str(tmp_path), staged=staged)
            assert {(r.page_id, r.title) for r in tables["page"].collect()} == {(f + k, f"P & {f + k}") for f in (1, 11) for k in range(5)}
            counts = {r.page_id: (r["n"], r.first, r.last) for r in tables["revision"].groupBy("page_id").agg(F.count("text").alias("n"), F.min("revision_id").alias("first"), F.max("revision_id").alias("last")).collect()}
            assert counts == {f + k: v for f in (1, 11) for k, v in ((0, (1, f * 10_000, f * 10_000)), (2, (1499, f * 10_000 + 1, f * 10_000 + 1499)), (3, (1, f * 10_000 + 2000, f * 10_000 + 2000)))}
            assert tables["revision"].where("text LIKE 'é <page> %' AND length(text) > 900").count() == 2 * 1501
        accepted = xml_dump.read_dump(spark, str(tmp_path), F.col("id") == 13)
        assert accepted["page"].count() == 1 and accepted["revision"].count() == 1499
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_dump_that_is_cut_off(spark, tmp_path):
    whole = dump(1)
    (tmp_path / "cut.xml").write_text(whole[: whole.index("<id>10500</id>") + 300])
    tables = xml_dump.read_dump(spark, str(tmp_path))
    assert tables["revision"].count() == 500 and tables["page"].count() == 3
