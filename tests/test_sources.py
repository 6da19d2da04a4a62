from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import graph, history, links
from palimpsest.sources import sql_dump
from palimpsest.sources.catalog import Catalog
from palimpsest.sources.xml_dump import in_namespaces

DUMP = str(Path(__file__).parent / "data" / "mini-wiki.xml")


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    made = Catalog(spark, str(tmp_path_factory.mktemp("wiki")))
    made.import_dump(DUMP, aliases={14: ["Kategorie"]})
    return made


def test_dump_tables(catalog):
    pages = {r.page_id: (r.ns_id, r.title) for r in catalog.read("page").collect()}
    assert pages == {1: (0, "Spring"), 2: (14, "Seasons"), 3: (2302, "clock"), 4: (0, "Time: a story"), 5: (10, "Note")}
    revisions = {r.revision_id: r for r in catalog.read("revision").collect()}
    assert sorted(revisions) == [10, 12, 13, 14, 20, 30, 40, 50]
    assert revisions[10].text.startswith("  Spring") and revisions[10].parent_id is None and revisions[10].minor is False
    assert revisions[13].bytes == 77 and revisions[13].minor and revisions[13].comment == "third"
    assert revisions[12].ip == "10.0.0.9" and revisions[12].contributor_id is None and revisions[12].comment is None and revisions[12].model == "UNKNOWN"
    assert revisions[20].ip is None and revisions[20].contributor_id is None and revisions[20].model == "WIKITEXT" and revisions[20].bytes == 0
    assert {r.contributor_id: r.name for r in catalog.read("contributor").collect()} == {5: "Ann2", 6: "Ben"}
    wiki = catalog.read("wiki").first()
    assert (wiki.db_name, wiki.api_url, wiki.case) == ("miniwiki", "https://mini.example.org/w/api.php", "FIRST_LETTER")
    names = {r.ns_id: r.all_names for r in catalog.read("namespace").collect()}
    assert names[14] == ["Category", "Kategorie"] and names[0] == [""]


def test_import_again_adds_nothing(catalog):
    before = {n: catalog.read(n).count() for n in ("wiki", "namespace", "page", "revision", "contributor")}
    catalog.import_dump(DUMP)
    assert before == {n: catalog.read(n).count() for n in before}


def test_order_and_as_of(catalog):
    spring = catalog.read("revision").where("page_id = 1")
    assert [r.revision_id for r in history.positions(spring).orderBy("rn").collect()] == [10, 12, 13, 14]
    at = lambda t: [r.revision_id for r in history.revision_at(spring, t).collect()]
    assert at("2003-12-01") == [12] and at("2003-06-01 08:00:00") == [12] and at("2003-01-01") == []
    assert [r.revision_id for r in history.latest_revision(spring).collect()] == [14]


def test_filtered_import(spark, tmp_path):
    made = Catalog(spark, str(tmp_path))
    made.import_dump(DUMP, accept=in_namespaces((14,)))
    assert [r.page_id for r in made.read("page").collect()] == [2]
    made.reset()
    assert made.read("page").count() == 0


def test_tuples():
    line = r"INSERT INTO `x` (`a`, `b`) VALUES (1,'it\'s \"q\" \\',NULL,''),(-2.5,'a,b)(','it''s','');"
    assert list(sql_dump.tuples(line)) == [["1", "it's \"q\" \\", None, ""], ["-2.5", "a,b)(", "it's", ""]]
    assert list(sql_dump.tuples("CREATE TABLE x (1);")) == []


def test_link_dumps(spark, catalog, tmp_path):
    (tmp_path / "miniwiki-2018-pagelinks.sql").write_text("-- x\nINSERT INTO `pagelinks` VALUES (1,0,'Time:_a_story'),(99,0,'Spring'),(1,0,'Nowhere'),(1,14,'Seasons');\n")
    (tmp_path / "miniwiki-2018-categorylinks.sql").write_text("INSERT INTO `categorylinks` VALUES (1,'Seasons','s'),(2,'Seasons','s');\nINSERT INTO `categorylinks` VALUES (4,'Seasons','t');\n")
    (tmp_path / "miniwiki-2018-redirect.sql").write_text("INSERT INTO `redirect` VALUES (4,0,'Spring',NULL,NULL),(5,0,'Spring','en',''),(5,0,'Spring','','');\n")
    catalog.import_links(*[str(p) for p in sorted(tmp_path.iterdir())])
    found = {(r.source_id, r.target_id, r.link_type) for r in catalog.read("link").collect()}
    assert found == {(1, 4, "ARTICLE"), (1, 2, "ARTICLE"), (1, 2, "CATEGORIZATION"), (2, 2, "CATEGORIZATION"), (4, 2, "CATEGORIZATION"), (4, 1, "REDIRECT"), (5, 1, "REDIRECT")}
    seeds = spark.createDataFrame([(2,)], "page_id long")
    layered = catalog.read("link")
    assert {r.page_id for r in graph.category_members(layered, seeds).collect()} == {1, 2, 4}
    assert {(r.page_id, r.depth) for r in graph.category_closure(layered, seeds).collect()} == {(1, 1), (4, 1)}
    (tmp_path / "usage.sql").write_text("INSERT INTO `wbc_entity_usage` VALUES (1,'Q1','S',1),(2,'Q1','S',1),(3,'Q2','L',77);\n")
    catalog.import_entity_usage(str(tmp_path / "usage.sql"), "miniwiki")
    assert [(r.page_id, r.aspect, r.entities) for r in links.entities_by_aspect(catalog.read("entity_usage")).collect()] == [(1, "S", ["Q1", "Q1"])]
    catalog.register()
    assert spark.sql("SELECT count(*) AS n FROM link WHERE link_type = 'REDIRECT'").first().n == 2


HTML = """<h1>Spring</h1>
<!-- <a href="/wiki/Hidden">x</a> --><a href="/wiki/Time:_a_story#top">t</a> <a class="x" href="/wiki/spring">self</a> <a href="http://x.org/wiki/Spring">e</a> <a href="/wiki/">n</a>
<a href="/wiki/Kategorie:Seasons">before</a><div id="catlinks"><a href="/wiki/Category:Seasons">after</a> <a href="/wiki/Bad%zz">bad</a></div>"""


def test_link_extraction(spark, catalog):
    t = F.lit("2005-01-01").cast("timestamp")
    tiers = spark.createDataFrame([("miniwiki", 1, HTML), ("miniwiki", 4, '<h1>T</h1> <p>Redirect to <a href="/wiki/Spring">S</a> <a href="/wiki/Template:Note">n</a>')], "db_name string, page_id long, html string").withColumn("ts", t)
    got = links.extract_links(tiers, catalog.read("page"), catalog.read("namespace"))
    found = {(r.source_id, r.target_id, r.link_type) for r in got.collect()}
    assert found == {(1, 4, "ARTICLE"), (1, 1, "ARTICLE"), (1, 2, "ARTICLE"), (1, 2, "CATEGORIZATION"), (4, 1, "REDIRECT"), (4, 1, "ARTICLE"), (4, 5, "ARTICLE")}
    early = tiers.withColumn("ts", F.lit("2003-02-02 12:00:00").cast("timestamp"))
    got = links.extract_links(early, catalog.read("page"), catalog.read("namespace"), catalog.read("revision"))
    assert {(r.source_id, r.target_id, r.link_type) for r in got.collect()} == {(1, 2, "ARTICLE"), (1, 2, "CATEGORIZATION")}
