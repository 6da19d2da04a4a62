import datetime
import random
from pathlib import Path
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import markup as M
from palimpsest.functions import text as X
from palimpsest.operators import evaluation, history, rendering
from palimpsest.operators.numbering import numbered
from palimpsest.sources import exports
from palimpsest.sources.catalog import Catalog
from palimpsest.streaming.incremental import compress_files, import_dumps, import_files

DUMP = Path(__file__).parent / "data" / "mini-wiki.xml"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert value(spark, X.xml_escape(lit('a<b & "c">'))) == "a&lt;b &amp; &quot;c&quot;&gt;"
    assert value(spark, X.xml_escape(lit(None).cast("string"))) == ""
    assert value(spark, X.graph_escape(lit("[a¤b]\n"))) == "(a b) "
    assert value(spark, X.quote_doubled(lit("it's"))) == "it''s"
    assert value(spark, X.without_control(lit("a\x07b\x85c"))) == "abc"
    assert [value(spark, X.first_upper(lit(t))) for t in ("élan vital", "ßa", "")] == ["Élan vital", "ßa", ""]
    assert value(spark, X.without_prefix(lit("A:b:c"), lit(4))) == "b:c" and value(spark, X.without_prefix(lit("A:b"), lit(0))) == "A:b"
    assert [value(spark, X.is_alphanumeric(lit(t))) for t in ("aé9", "a b", "", "a\n")] == [True, False, False, False]
    assert [value(spark, X.is_number(lit(t))) for t in ("1e5", "12", "NaN", "x", "")] == [True, True, True, False, False]
    assert value(spark, X.wiki_redirect_target(lit("#REDIRECT [[ Spring ]]"))) == "Spring" and value(spark, X.wiki_redirect_target(lit("x"))) is None
    assert value(spark, X.iso_instant(lit("2004-01-01 12:00:00").cast("timestamp"), "Europe/Berlin")) == "2004-01-01T13:00:00"
    assert value(spark, X.html_to_text(lit("<p>a <b>b</b>&amp;c</p><script>x</script> d"))) == "a b &c d"
    assert value(spark, X.longest_common_substring(lit("xabcy"), lit("zabcabc"))) == "abc" and value(spark, X.longest_common_substring(lit(""), lit("a"))) == ""


def test_plain_text_equals_its_sql(spark, tmp_path):
    import duckdb

    from palimpsest.plans.queries import html6
    from palimpsest.plans.registry import ORACLE_SQL

    odd = ["a &amp&amp; b &ampcopy; &lt x &lt;", "&amp;lt; &amp;amp;", "\u00a0a\u00a0 \u2003b\x0b\t\f c \x85", "<p>x</p>&middot;<style\n>.a{}</STYLE\n> y<scripted>z</scripted>", "<!-- <script> -->k<script>\n1</script\t>l</script>", "", " \n ", None]
    spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        expected = dict(base.execute(ORACLE_SQL["html6_plain_text"]).fetchall())
    assert {r.page_id: r.text for r in html6(spark, str(tmp_path)).collect()} == expected
    assert value(spark, X.html_to_text(F.lit("&eacute;&#233;&#xE9; &hellip; &unknown; &ampersand;"))) == "ééé … &unknown; &ampersand;"


def test_codes(spark):
    df = spark.createDataFrame([("wikitext",), (None,), ("odd",)], "m string")
    assert [r.x for r in df.select(X.decoded(X.MODELS, F.col("m"), "WIKITEXT", "UNKNOWN").alias("x")).collect()] == ["WIKITEXT", "WIKITEXT", "UNKNOWN"]
    with pytest.raises(Exception, match="unknown name"):
        df.select(X.decoded(X.FORMATS, F.col("m"), "TEXT_XWIKI", None)).collect()


def test_render():
    text = "'''Bold''' and ''it'' [[winter|cold]] {{note|x}}\n\n== Part ==\n* a\n** b\n# c\n{|\n|-\n! h\n| c1 || c2\n|}\n[[Category:Seasons]] <!-- gone -->"
    html = M.render("T<", text, {"Note": "(n {{{1}}}{{inner}})", "Inner": "!"})
    for part in ("<h1>T&lt;</h1>", "<b>Bold</b>", "<i>it</i>", '<a href="/wiki/winter">cold</a>', "(n x!)", "<h2>Part</h2>", "<ul>\n<li>a</li>\n<ul>\n<li>b</li>", "<ol>", "<td>c2</td>", '<div id="catlinks"><a href="/wiki/Category:Seasons">'):
        assert part in html, part
    assert "gone" not in html
    assert 'class="redirectMsg"' in M.render("T", "#REDIRECT [[Spring]]")
    assert M.render("T", "{{loop}}", {"Loop": "{{loop}}"}) == "<h1>T</h1>\n" and M.render("T", None) is None


def test_render_literal_text_notes_and_nesting():
    text = (
        '__NOTOC__ {{PAGENAME}} has<ref>First [[a]]</ref> and<ref name="n">Second</ref> again<ref name="n"/> <nowiki>\'\'\'[[x]]\'\'\' <b></nowiki>\n<pre>\n* no list\n</pre>\n----\n'
        "{|\n| a\n{|\n| b\n|}\n|-\n| c\n|}\n<references/>\nend"
    )
    html = M.render("T", text)
    for part in (
        "T has<sup>", '[2]</a></sup> again<sup><a href="#note-2">[2]', "'''[[x]]''' &lt;b&gt;", "<pre>\n* no list\n</pre>\n<hr/>\n",
        "<table>\n<tr><td>a</td><td><table>\n<tr><td>b</td></tr>\n</table></td></tr>\n<tr><td>c</td></tr>\n</table>\n",
        '<ol class="references">\n<li id="note-1">First <a href="/wiki/a">a</a></li>\n<li id="note-2">Second</li>\n</ol>\n<p>end</p>',
    ):
        assert part in html, part
    assert "NOTOC" not in html and "\x7f" not in html and M.render("T", "x<ref>y</ref>").endswith('<ol class="references">\n<li id="note-1">y</li>\n</ol>\n')
    assert M.render("T", "a \x7f0\x7f b") == "<h1>T</h1>\n<p>a 0 b</p>\n"


def test_tei():
    html = '<html><head><title>x</title></head><body>bare <b>t</b><h2>H</h2><p>a<br>b <a href="/w">l</a></p><ul><li>i</ul><div id="catlinks">KATZE</div></body></html>'
    tei = M.html_to_tei(html, "Ti<", {"pageID": "7"})
    ElementTree.fromstring(tei)
    assert "<title>Ti&lt;</title>" in tei and '<idno type="pageID">7</idno>' in tei and '<p>bare <hi rend="bold">t</hi></p><head>H</head>' in tei and '<link target="/w">l</link>' in tei and "KATZE" not in tei
    assert "KATZE" in M.html_to_tei(html, drop_categories=False)
    flat = M.html_to_tei(html, flat=True)
    assert ElementTree.fromstring(flat) is not None and "<hi" not in flat


XMI = """<xmi:XMI xmlns:xmi="http://www.omg.org/XMI" xmlns:cas="c" xmlns:t="http:///type.ecore" xmlns:pos="http:///x/pos.ecore">
<cas:Sofa xmi:id="1" sofaString="Hi there."/><t:Paragraph xmi:id="9" begin="0" end="9"/><t:Sentence xmi:id="2" begin="0" end="9"/>
<t:Lemma xmi:id="3" value="hi"/><pos:X xmi:id="4" PosValue="pos=INTJ"/><t:MorphologicalFeatures xmi:id="5" value="number=sg"/>
<t:Token xmi:id="6" begin="0" end="2" lemma="3" pos="4" morph="5"/><t:Token xmi:id="7" begin="3" end="8"/><t:Token xmi:id="8" begin="8" end="9" lemma="3"/></xmi:XMI>"""


def test_xmi():
    tei = M.xmi_to_tei(XMI)
    assert '<p><s><w lemma="hi" type="INTJ" number="sg">Hi</w><w>there</w><c>.</c></s></p>' in tei
    for bad in ('<t:Odd begin="0"/>', '<t:MorphologicalFeatures xmi:id="5" value="odd=1"/>'):
        with pytest.raises(ValueError):
            M.xmi_to_tei(XMI.replace('<t:Lemma xmi:id="3" value="hi"/>', bad).replace('value="number=sg"', 'value=""' if "odd" not in bad else 'value="odd=1"'))


def test_numbering(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "a int").repartition(7)
    assert [(r.number, r.a) for r in numbered(df, ["a"]).orderBy("number").collect()] == [(i + 1, i) for i in range(101)]
    assert numbered(df.limit(0), ["a"]).count() == 0


def graph_tables(spark):
    t = datetime.datetime(2004, 1, 1)
    tiers = spark.createDataFrame([(1, t, 0, "A [x]"), (2, t, 14, "B&"), (3, t, 0, "C")], "page_id long, ts timestamp, ns_id int, title string")
    edges = spark.createDataFrame([(1, 2, "CATEGORIZATION", t), (1, 3, "ARTICLE", t), (1, 9, "ARTICLE", t), (3, 1, "ARTICLE", datetime.datetime(2005, 1, 1)), (3, 2, "ARTICLE", t)], "source_id long, target_id long, link_type string, ts timestamp")
    return tiers, edges


GRAPHML = """<?xml version="1.0" encoding="utf-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://graphml.graphdrawing.org/xmlns http://graphml.graphdrawing.org/xmlns/1.0/graphml.xsd">
<key id="d0" for="node" attr.name="title" attr.type="string"/>
<key id="d1" for="node" attr.name="ns" attr.type="integer"/>
<key id="d2" for="node" attr.name="articleID" attr.type="integer"/>
<key id="d3" for="node" attr.name="timestamp" attr.type="string"/>
<key id="d4" for="edge" attr.name="type" attr.type="string"/>
<node id="n1">
<data key="d0">A [x]</data>
<data key="d1">0</data>
<data key="d2">1</data>
<data key="d3">2004-01-01T00:00:00Z[UTC]</data>
</node>
<node id="n2">
<data key="d0">B&amp;</data>
<data key="d1">14</data>
<data key="d2">2</data>
<data key="d3">2004-01-01T00:00:00Z[UTC]</data>
</node>
<node id="n3">
<data key="d0">C</data>
<data key="d1">0</data>
<data key="d2">3</data>
<data key="d3">2004-01-01T00:00:00Z[UTC]</data>
</node>
<edge id="e1" source="n1" target="n2">
<data key="d4">CATEGORIZATION</data>
</edge>
<edge id="e2" source="n1" target="n3">
<data key="d4">ARTICLE</data>
</edge>
<edge id="e4" source="n3" target="n2">
<data key="d4">ARTICLE</data>
</edge>
</graphml>
"""
GRAPH_TEXT = """directed
SimilarityGraph
Vertex Attributes:[Title¤String];[NSID¤Integer];[Timestamp¤String];
Edge Attributes:[Type¤String];
ProbabilityMassOfGraph: 0
Vertices:
n1¤[Title¤A (x)¤]¤[NSID¤0¤]¤[Timestamp¤2004-01-01T00:00:00Z(UTC)¤]¤
n2¤[Title¤B&¤]¤[NSID¤14¤]¤[Timestamp¤2004-01-01T00:00:00Z(UTC)¤]¤
n3¤[Title¤C¤]¤[NSID¤0¤]¤[Timestamp¤2004-01-01T00:00:00Z(UTC)¤]¤
Edges:
n1¤n3¤1.0¤[Type¤ARTICLE¤]¤
n3¤n2¤1.0¤[Type¤ARTICLE¤]¤
"""


def written(lines, path):
    exports.write_lines(lines, str(path))
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_exports(spark, tmp_path):
    tiers, edges = graph_tables(spark)
    assert written(exports.graphml(tiers, edges, ("ARTICLE", "CATEGORIZATION")), tmp_path / "g") == GRAPHML
    assert exports.graphml(tiers, edges).where("value like '<edge %'").count() == 0
    assert written(exports.tier_graph_text(tiers, edges, ("ARTICLE",)), tmp_path / "t") == GRAPH_TEXT
    fine = spark.createDataFrame([(datetime.datetime(2004, 1, 1, 1, 2, 3, 450000),)], "ts timestamp")
    assert fine.select(X.zoned_instant(F.col("ts")).alias("x")).first().x == "2004-01-01T01:02:03.45Z[UTC]"
    named = tiers.withColumn("namespace", F.when(F.col("ns_id") == 14, "Category").otherwise(""))
    html = named.withColumn("html", F.lit("<body><p>x</p></body>"))
    corpus = "\n".join(r.value for r in exports.tei_corpus(html, ["page_id"]).collect())
    assert len(ElementTree.fromstring(corpus.encode()).findall("{*}TEI")) == 3 and "Category:B&amp;" in corpus


def test_snapshot_and_current_graph(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "wiki"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "mini.xml").write_text(DUMP.read_text().replace("Spring again.", "Spring {{note|q}} [[Category:Seasons]]"))
    import_dumps(catalog, str(tmp_path / "in"), str(tmp_path / "c1"), once=True).awaitTermination(120)
    assert catalog.read("revision").count() == 8
    pages, revisions = catalog.read("page"), catalog.read("revision")
    html = {r.page_id: r.html for r in rendering.render_snapshot(pages, revisions, "2004-06-01").collect()}
    assert "(note q)" in html[1] and 'id="catlinks"' in html[1] and "redirectMsg" in html[4] and set(html) == {1, 2, 3, 4, 5}
    assert {r.page_id for r in rendering.render_snapshot(pages, revisions, "2003-02-02 12:00:00").collect()} == {2, 3}
    late = rendering.templates_at(pages, revisions, "2001-01-01").collect()
    assert [(r.title, r.body) for r in late] == [("Note", "(note {{{1}}})")]
    named = pages.join(catalog.read("namespace").select("ns_id", F.col("name").alias("namespace")), "ns_id")
    links = spark.createDataFrame([(4, 1, "REDIRECT")], "source_id long, target_id long, link_type string").withColumn("ts", F.lit("3000-01-01").cast("timestamp"))
    lines = [r.value for r in exports.current_graph_text(named, revisions, links).collect()]
    assert "4_40¤1_14¤1.0¤[Type¤REDIRECT¤]¤" in lines
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text('{"db_name":"miniwiki","page_id":77,"ns_id":0,"title":"New"}\n{"db_name":"miniwiki","page_id":1,"ns_id":0,"title":"Spring"}\n')
    seen = []
    import_files(catalog, "page", str(tmp_path / "json"), str(tmp_path / "c2"), listener=lambda name, batch: seen.append((name, batch.count())), once=True).awaitTermination(120)
    assert catalog.read("page").count() == 6 and seen == [("page", 2)]


def test_link_evaluation(spark):
    pages = spark.createDataFrame([(i,) for i in range(1, 5)], "page_id long")
    schema = "page_id long, link_type string, target_id long"
    gold = spark.createDataFrame([(1, "ARTICLE", 5), (2, "ARTICLE", 5), (2, "ARTICLE", 6), (9, "ARTICLE", 1)], schema)
    test = spark.createDataFrame([(2, "ARTICLE", 5), (3, "ARTICLE", 5)], schema)
    got = {r.link_type: (r.recall, r.precision, r.f_score, r.page_count) for r in evaluation.link_evaluation(pages, gold, test).collect()}
    assert got["ARTICLE"] == pytest.approx((2.5 / 4, 3 / 4, (1 + 2 / 3) / 4, 4)) and got["REDIRECT"] == (1, 1, 1, 4)
    stats = spark.createDataFrame([(100, 10, "BZIP2"), (100, 5, "DIFFBZIP2")], "raw_bytes long, stored_bytes long, codec string")
    assert tuple(evaluation.compression_statistics(stats).first()) == (7.5, 0.5)


def test_intervals_and_sequences(spark):
    rows = spark.createDataFrame([(1, i, datetime.datetime(2020, 1, i)) for i in (3, 1, 2)] + [(2, 9, datetime.datetime(2020, 1, 2))], "page_id long, revision_id long, ts timestamp")
    got = {(r.page_id, r.revision_id): (r.valid_from.day, r.valid_to.year) for r in history.intervals(rows).collect()}
    assert got[1, 3] == (3, 3000) and got[1, 1] == (1, 2020)
    start = spark.createDataFrame([(1, 2)], "page_id long, revision_id long")
    assert [(r.revision_id, r.rn) for r in history.sequence_from(rows, start).orderBy("rn").collect()] == [(2, 1), (3, 2)]
    many = spark.createDataFrame([("2020-01-02",), ("2019-01-01",)], "at string")
    assert {(r.page_id, r.revision_id) for r in history.snapshots(rows, many).collect()} == {(1, 2), (2, 9)}
    assert {r.page_id for r in history.new_tiers(rows, rows, "2020-01-02").collect()} == set()
    assert {r.page_id for r in history.new_tiers(rows, rows, "2020-01-03").collect()} == {2}


def test_crowded_pages_give_the_same(spark, monkeypatch):
    r = random.Random(1)
    rows = [(p, p * 1000 + i, datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=r.randrange(40)), f"x{i}") for p, n in ((1, 90), (2, 1), (3, 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id long, revision_id long, ts timestamp, text string").repartition(5)
    starts = spark.createDataFrame([(1, 1005), (3, 3003), (2, 77)], "page_id long, revision_id long")

    def all_of():
        found = history.positions(df), history.neighbours(df), history.intervals(df), history.key_frames(df, 10), history.sequence_from(df, starts)
        return [sorted(map(str, x.select(*sorted(x.columns)).collect())) for x in found]

    want = all_of()
    monkeypatch.setattr(history, "WINDOW_ROWS", 5)
    assert history.crowded(df) and all_of() == want
    assert history.positions(df.limit(0)).count() == 0


def test_snapshots_by_brute_force(spark):
    r = random.Random(2)
    day = lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=n)
    rows = [(r.randrange(6), i, day(r.randrange(20))) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, revision_id long, ts timestamp").repartition(4)
    asked = [day(-3), day(4), day(4), day(11), day(40)]
    got = {(x["at"], x.page_id, x.revision_id) for x in history.snapshots(df, spark.createDataFrame([(a,) for a in asked], "at timestamp")).collect()}
    want = set()
    for at in asked:
        for page in range(6):
            held = [(ts, i) for p, i, ts in rows if p == page and ts <= at]
            if held:
                want.add((at, page, max(held)[1]))
    assert got == want and history.snapshots(df, spark.createDataFrame([], "at timestamp")).count() == 0
    many = spark.range(history.MAX_INSTANTS + 1).select(F.timestamp_seconds("id").alias("at"))
    with pytest.raises(ValueError):
        history.snapshots(df, many)


def test_common_substring():
    r = random.Random(3)
    for _ in range(400):
        a, b = ("".join(r.choices("abc", k=r.randrange(14))) for _ in range(2))
        runs = [(-n, i) for n in range(1, len(a) + 1) for i in range(len(a) - n + 1) if a[i : i + n] in b]
        n, i = min(runs, default=(0, 0))
        assert X.common_substring(a, b) == a[i : i - n]
    assert len(X.common_substring("ab" * 50_000, "ba" * 50_000)) == 99_999


def test_compression_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"db_name":"w","page_id":1,"revision_id":5,"text":"aaaa"}\n{"db_name":"w","page_id":1,"revision_id":6}\n')
    told = []
    for _ in range(2):  # the second run finds nothing new
        compress_files(Catalog(spark, str(tmp_path / "c")), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "GZIP", lambda n, done: told.extend(map(tuple, done.sort("revision_id").select("revision_id", "codec", "raw_bytes", F.col("stored_bytes") > 4).collect())), once=True).awaitTermination(120)
    assert told == [(5, "GZIP", 4, True), (6, "GZIP", None, None)]


def test_templates_as_deep_as_texts_go(spark):
    texts = spark.createDataFrame([(1, "{{t0}}"), (2, "none"), (3, "{{loop}}")], "page_id long, text string")
    bodies = spark.createDataFrame([(f"T{k}", f"{{{{t{k + 1}}}}}") for k in range(8)] + [("T8", "end"), ("Loop", "{{loop}} {{t8}}")], "title string, body string")
    got = {r.page_id: r.templates for r in rendering.with_templates(texts, bodies).collect()}
    assert set(got[1]) == {f"T{k}" for k in range(9)} and got[2] is None and set(got[3]) == {"Loop", "T8"}
