from pathlib import Path

import pytest

from palimpsest.__main__ import main
from palimpsest.operators import lookups
from palimpsest.sources.catalog import Catalog

DUMP = (Path(__file__).parent / "data" / "mini-wiki.xml").read_text()
AT = "2004-06-01 00:00:00"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("flow")
    (path / "mini.xml").write_text(DUMP.replace("Spring again.", "[[Time: a story|story]] [[:Category:Seasons]] {{note|q}} [[Category:Seasons]]"))
    (path / "miniwiki-pagelinks.sql").write_text("INSERT INTO `pagelinks` VALUES (1,0,'Time:_a_story'),(1,14,'Seasons'),(4,0,'Spring');\n")
    (path / "miniwiki-categorylinks.sql").write_text("INSERT INTO `categorylinks` VALUES (1,'Seasons','s');\n")
    main([f"{path}/tables", "importdumps", f"{path}/mini.xml"])
    main([f"{path}/tables", "importlinks", f"{path}/miniwiki-pagelinks.sql", f"{path}/miniwiki-categorylinks.sql"])
    return path


def test_network_at_an_instant(spark, folder, capsys):
    tables = f"{folder}/tables"
    for _ in range(2):  # again adds nothing
        main([tables, "pagetiers", "miniwiki", AT])
        main([tables, "network", "miniwiki", AT])
    catalog = Catalog(spark, tables)
    assert catalog.read("page_tier").count() == 5
    found = {(r.source_id, r.target_id, r.link_type) for r in catalog.read("link").where(f"ts = timestamp '{AT}'").collect()}
    assert found == {(1, 4, "ARTICLE"), (1, 2, "ARTICLE"), (1, 2, "CATEGORIZATION"), (4, 1, "REDIRECT"), (4, 1, "ARTICLE")}
    main([tables, "evaluate", "miniwiki", AT])
    shown = capsys.readouterr().out
    assert "ARTICLE" in shown and "|5 " in shown
    main([tables, "export", "miniwiki", AT, f"{folder}/graph"])
    text = "".join(p.read_text() for p in sorted((folder / "graph").glob("part-*")))
    assert "n4¤n1¤1.0¤[Type¤REDIRECT¤]¤" in text


def test_lookups(spark, folder):
    catalog = Catalog(spark, f"{folder}/tables")
    pages, names = catalog.read("page"), catalog.read("namespace")
    ids = lambda df: sorted(r.page_id for r in df.collect())
    assert lookups.wiki_by_name(catalog.read("wiki"), "miniwiki").count() == 1
    assert [r.ns_id for r in lookups.namespace_by_name(names, "Category").collect()] == [14] and lookups.namespace_by_name(names, "category").count() == 0
    assert ids(lookups.pages_by_title(pages, names, 0, "spring")) == [1] and ids(lookups.pages_by_title(pages, names, 2302, "Clock")) == []
    assert ids(lookups.pages_by_id(pages, [2, 99])) == [2] and ids(lookups.in_namespaces(pages, (14,))) == [2]
    assert lookups.in_namespaces(pages, ()).count() == 5 and lookups.in_namespaces(pages, (), empty_means_all=False).count() == 0
    titles = spark.createDataFrame([("miniwiki", t) for t in ("Spring", "Category:Seasons", "Time: a story", "Gadget:clock", "Gadget:Clock", "Nope")], "db_name string, target string")
    found = {r.target: r.page_id for r in lookups.pages_by_qualified_titles(pages, names, titles).collect()}
    assert found == {"Spring": 1, "Category:Seasons": 2, "Time: a story": 4, "Gadget:clock": 3, "Gadget:Clock": None, "Nope": None}
    assert lookups.revisions_by_id(catalog.read("revision"), [10, 12]).count() == 2 and lookups.contributors_named(catalog.read("contributor"), "Ben").first().contributor_id == 6
    tables = {"page": pages, "contributor": catalog.read("contributor"), "namespace": names}
    assert ids(lookups.by_unique_id(tables, "page:miniwiki:2")) == [2] and lookups.by_unique_id(tables, "contributor:miniwiki:6").first().name == "Ben"
    assert lookups.by_unique_id(tables, "namespace:miniwiki:Category").first().ns_id == 14 and lookups.by_unique_id(tables, "page:other:2").count() == 0
    for bad in ("wiki:x", "page:miniwiki"):
        with pytest.raises(ValueError):
            lookups.by_unique_id(tables, bad)
    rows = spark.createDataFrame([(1, " a b  a"), (2, "")], "page_id long, text string")
    assert [(r.page_id, r.terms) for r in lookups.term_counts(rows, ["page_id"]).collect()] == [(1, {"a": 2, "b": 1})]
    assert lookups.namespace_names(names).count() == names.count() and lookups.entities(catalog.read("entity_usage")).count() == 0
