"""Revisions that are read by a pattern, and dumps that are not shuffled or unpacked on the disk."""

import glob

from pyspark.sql import functions as F

from palimpsest.plans import imports
from palimpsest.sources import xml_dump
from tests.test_big_pages import SITE, dump

WHO = "<contributor><username>Ann é</username><id>5</id></contributor>"
TEXT = '<text xml:space="preserve">  a &lt;b&gt; &amp;amp; &quot;c&apos;\n</text>'


def revision(number, who=WHO, rest="<model>wikitext</model><format>text/x-wiki</format>", text=TEXT, at="2004-01-01T00:00:00Z", parent="<parentid>9</parentid>"):
    return f"<page><title>T</title><ns>0</ns><id>1</id>\n<revision>\n <id>{number}</id>\n {parent}<timestamp>{at}</timestamp>{who}{rest}{text}"


USUAL = [
    revision(1), revision(2, parent=""), revision(3, "<contributor><ip>10.0.0.1</ip></contributor>"), revision(4, rest="<minor/><comment></comment>"), revision(5, rest="<minor />\n<comment>x y</comment><model>css</model>"),
    revision(6, text='<text bytes="77" xml:space="preserve">a</text>\n<sha1>abc</sha1>\n'), revision(7, text="<text></text>"),
    revision(8, rest='<minor/><comment> x</comment>', text='<text xml:space="preserve">\n a</text>'),
]
ODD = [
    revision(11, text="<text><![CDATA[<b>]]></text>"), revision(12, text="<text>&#65;</text>"), revision(13, '<contributor deleted="deleted" />'), revision(14, text='<text deleted="deleted" />'), revision(15, text="<text>a\r\nb</text>"),
    revision(16, rest="<comment>&lt;!</comment>"), revision(17, rest="<!-- x -->"), revision(18, text="<text>cut")[:-3], revision(19, text="<text>&nbsp;</text>"),
    revision(20, text="<text>\n</text>"), revision(21, rest="<comment> </comment>"),
]


def test_the_pattern_finds_what_the_parser_does(spark):
    assert all(xml_dump._usual(x) for x in USUAL) and not any(xml_dump._usual(x) for x in ODD)
    kinds = xml_dump._LOCATED.partition("value string, ")[2]
    value = F.substr("value", F.locate("<revision>", F.col("value")) + len("<revision>")).alias("value")
    parsed = spark.createDataFrame([(x, *(None,) * len(xml_dump.FOUND)) for x in USUAL], f"value string, {kinds}").select(value, *xml_dump.FOUND)
    found = spark.createDataFrame([(None, *xml_dump._usual(x)) for x in USUAL], f"value string, {kinds}")
    r = F.col("r")
    fields = [r["id"], r["parentid"], r["timestamp"], r["contributor"]["username"], r["contributor"]["id"], r["contributor"]["ip"], r["minor"].isNotNull(), F.nullif(r["comment"], F.lit("")), r["model"], r["format"], F.coalesce(r["text"]["_VALUE"], F.lit("")), r["text"]["_bytes"], r["sha1"]]
    rows = [[tuple(x) for x in df.select(xml_dump._revision_of().alias("r")).select(*fields).collect()] for df in (parsed, found)]
    assert rows[0] == rows[1]


def test_odd_and_usual_revisions_of_a_dump(spark, tmp_path):
    (tmp_path / "odd.xml").write_text(SITE + "".join(f"{x}</revision></page>\n" for x in USUAL + ODD[:7] + USUAL[:1]) + "</mediawiki>", newline="")
    rows = {r.revision_id: r for r in xml_dump.read_dump(spark, str(tmp_path))["revision"].collect()}
    assert sorted(rows) == [*range(1, 9), *range(11, 18)]
    assert rows[1].text == "  a <b> &amp; \"c'\n" and rows[11].text == "<b>" and rows[12].text == "A" and rows[16].comment == "<!" and rows[6].bytes == 77


def test_no_text_is_shuffled_where_nothing_repeats(spark, tmp_path):
    (tmp_path / "dump.xml").write_text(dump(1))
    revisions = xml_dump.read_dump(spark, str(tmp_path))["revision"]
    plan = revisions._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "LeftSemi" not in plan and "Aggregate [revision_id" not in plan


def test_the_dump_of_the_tables_is_packed(spark):
    path = imports.dump(spark, "/root/testdata/sf0.001").removeprefix("file://")
    assert glob.glob(f"{path}/file=*/*.gz") and not glob.glob(f"{path}/file=*/*.txt")
