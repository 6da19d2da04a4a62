"""Queries of look-ups, joins and tiers over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import codecs
from palimpsest.functions import text as X
from palimpsest.operators import history, lookups, numbering, rendering, tiers
from palimpsest.plans.adapters import revisions, table, turns
from palimpsest.plans.registry import query
from palimpsest.sources.exports import qualified_title
from palimpsest.storage import materialise

# The wiki of these queries: parts are pages, line items their revisions, suppliers the authors.
CASE_NS = "CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 14 ELSE 2302 END"
PAGES_SQL = f"SELECT 'tpch' AS db_name, p_partkey AS page_id, {CASE_NS} AS ns_id, 'Part ' || (p_partkey % 900) AS title FROM part"
#: Line items may repeat a number; of those, the first by (part, supplier, date) counts.
ITEMS_SQL = "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) = 1"
REVISIONS_SQL = f"SELECT l_partkey AS page_id, l_orderkey * 10 + l_linenumber AS revision_id, l_shipdate AS ts, l_suppkey AS contributor_id, l_returnflag || ' ' || l_linestatus AS text FROM ({ITEMS_SQL})"
NAMESPACES = [("tpch", 0, "FIRST_LETTER", "", [""]), ("tpch", 14, "FIRST_LETTER", "Category", ["Category", "Kategorie"]), ("tpch", 2302, "CASE_SENSITIVE", "Gadget", ["Gadget"])]
NS_NAME = "CASE ns_id WHEN 14 THEN 'Category' WHEN 2302 THEN 'Gadget' ELSE '' END"


def part_namespace():
    return F.when(F.col("p_size") % 3 == 0, 0).when(F.col("p_size") % 3 == 1, 14).otherwise(2302)


def pages(spark, d):
    part = table(spark, d, "part")
    title = F.concat(F.lit("Part "), F.col("p_partkey") % 900)
    return part.select(F.lit("tpch").alias("db_name"), F.col("p_partkey").alias("page_id"), part_namespace().alias("ns_id"), title.alias("title"))


def namespaces(spark):
    return spark.createDataFrame(NAMESPACES, "db_name string, ns_id int, case string, name string, all_names array<string>")


def distinct_items(spark, d):
    items = table(spark, d, "lineitem")
    rest = [c for c in items.columns if c not in ("l_orderkey", "l_linenumber")]
    first = F.min_by(F.struct(*rest), F.struct("l_partkey", "l_suppkey", "l_shipdate")).alias("first")
    return items.groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "first.*")


def brief_items(spark, d):
    """``distinct_items`` with what a dump needs of them."""
    order = F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus")
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(order).alias("first")).select("l_orderkey", "l_linenumber", "first.*")


def item_revisions(spark, d):
    items = distinct_items(spark, d)
    return items.select(
        F.col("l_partkey").alias("page_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("revision_id"), F.col("l_shipdate").alias("ts"),
        F.col("l_suppkey").alias("contributor_id"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text"),
    )


def contributors(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("contributor_id"), F.col("s_name").alias("name"))


# Look-ups


@query("flt1_wiki_by_name", "SELECT r_name AS db_name, r_regionkey FROM region WHERE r_name = 'ASIA'")
def flt1(spark, d):
    return lookups.wiki_by_name(table(spark, d, "region").withColumnRenamed("r_name", "db_name"), "ASIA")


@query("flt2_namespace_by_name", "SELECT n_regionkey AS ns_id FROM nation WHERE n_name = 'NATION_7'")
def flt2(spark, d):
    names = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("ns_id")).agg(F.collect_list("n_name").alias("all_names"))
    return lookups.namespace_by_name(names, "NATION_7").select("ns_id")


@query("flt3_namespace_names", "SELECT DISTINCT 'tpch' AS db_name, n_name AS any_name, n_regionkey AS ns_id FROM nation")
def flt3(spark, d):
    names = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("ns_id")).agg(F.collect_list("n_name").alias("all_names"))
    return lookups.namespace_names(names.withColumn("db_name", F.lit("tpch")))


@query("flt4_page_by_id", f"SELECT * FROM ({PAGES_SQL}) WHERE page_id IN (3, 14, 159)")
def flt4(spark, d):
    return lookups.pages_by_id(pages(spark, d), [3, 14, 159])


@query("flt5_page_by_title", f"SELECT * FROM ({PAGES_SQL}) WHERE ns_id = 14 AND title = 'Part 8' OR ns_id = 0 AND title = 'Part 9' QUALIFY row_number() OVER (PARTITION BY ns_id ORDER BY page_id) = 1")
def flt5(spark, d):
    find = lambda ns, title: lookups.pages_by_title(pages(spark, d), namespaces(spark), ns, title).select("db_name", "page_id", "ns_id", "title")
    return find(14, "part 8").unionByName(find(0, "part 9")).unionByName(find(2302, "part 7"))


@query("flt7_revision_by_id", f"SELECT * FROM ({REVISIONS_SQL}) WHERE revision_id < 4000 AND revision_id % 7 = 3")
def flt7(spark, d):
    return lookups.revisions_by_id(item_revisions(spark, d), list(range(3, 4000, 7)))


@query("flt8_contributor", "SELECT s_suppkey AS contributor_id, s_name AS name, s_name = 'Supplier#000000002' AS by_name FROM supplier WHERE s_name = 'Supplier#000000002' OR s_suppkey IN (4, 5)")
def flt8(spark, d):
    people = contributors(spark, d)
    by_name = lookups.contributors_named(people, "Supplier#000000002").withColumn("by_name", F.lit(True))
    return by_name.unionByName(lookups.contributors(people, (4, 5)).withColumn("by_name", F.lit(False)))


@query("flt9_entities", "SELECT DISTINCT event_type || user_id % 10 AS entity_id FROM events")
def flt9(spark, d):
    return lookups.entities(table(spark, d, "events").select(F.concat("event_type", F.col("user_id") % 10).alias("entity_id")))


@query("flt11_contributors", "SELECT s_suppkey AS contributor_id, s_name AS name FROM supplier")
def flt11(spark, d):
    return lookups.contributors(contributors(spark, d))


@query("flt12_by_unique_id", f"SELECT page_id, title FROM ({PAGES_SQL}) WHERE page_id = 17 UNION ALL SELECT revision_id, text FROM ({REVISIONS_SQL}) WHERE revision_id = 33")
def flt12(spark, d):
    tables = {"page": pages(spark, d), "revision": item_revisions(spark, d).withColumn("db_name", F.lit("tpch"))}
    page, revision = (lookups.by_unique_id(tables, x) for x in ("page:tpch:17", "revision:tpch:33"))
    return page.select("page_id", "title").unionByName(revision.select(F.col("revision_id").alias("page_id"), F.col("text").alias("title")))


@query("flt14_tier_namespaces", f"SELECT page_id FROM ({PAGES_SQL}) WHERE ns_id IN (0, 2302)")
def flt14(spark, d):
    chosen = lookups.in_namespaces(pages(spark, d), (0, 2302), empty_means_all=False)
    return chosen.unionByName(lookups.in_namespaces(pages(spark, d), (), empty_means_all=False)).select("page_id")


@query("flt16_unrendered", "SELECT page_id FROM pages WHERE page_id % 3 = 1 OR html IS NULL")
def flt16(spark, d):
    return history.unrendered(table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 != 1, F.col("html")).alias("html"))).select("page_id")


# Joins


@query("jn1_revision_page", f"SELECT revision_id, page_id, ns_id, title FROM ({REVISIONS_SQL}) r JOIN ({PAGES_SQL}) p USING (page_id)")
def jn1(spark, d):
    return history.with_page(item_revisions(spark, d), pages(spark, d)).select("revision_id", "page_id", "ns_id", "title")


@query("jn2_page_revisions", f"SELECT page_id, title, revision_id, row_number() OVER (PARTITION BY page_id ORDER BY ts, revision_id) AS rn FROM ({PAGES_SQL}) p JOIN ({REVISIONS_SQL}) r USING (page_id) WHERE ns_id = 14")
def jn2(spark, d):
    chosen = lookups.in_namespaces(pages(spark, d), (14,))
    placed = history.positions(item_revisions(spark, d).select("page_id", "revision_id", "ts"))
    return history.with_page(placed, chosen).select("page_id", "title", "revision_id", F.col("rn").cast("long"))


@query("jn4_contributor_revisions", f"SELECT s_name AS name, revision_id FROM supplier JOIN ({REVISIONS_SQL}) r ON contributor_id = s_suppkey WHERE s_acctbal > 0")
def jn4(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("contributor_id"), F.col("s_name").alias("name"))
    return history.by_contributor(item_revisions(spark, d), rich).select("name", "revision_id")


@query("jn6_qualified_title", f"SELECT page_id, CASE WHEN ns_id = 0 THEN title ELSE {NS_NAME} || ':' || title END AS qualified FROM ({PAGES_SQL})")
def jn6(spark, d):
    names = namespaces(spark).select("db_name", "ns_id", "name")
    named = pages(spark, d).join(F.broadcast(names), ["db_name", "ns_id"])
    return named.select("page_id", qualified_title(F.col("name"), F.col("title")).alias("qualified"))


@query(
    "jn11_target_resolution",
    f"""WITH p AS (SELECT ns_id, title, min(page_id) AS page_id FROM ({PAGES_SQL}) GROUP BY ALL)
    SELECT c_custkey AS id, page_id FROM customer LEFT JOIN p ON ns_id = (CASE c_custkey % 4 WHEN 1 THEN 14 WHEN 2 THEN 2302 ELSE 0 END)
      AND title = CASE c_custkey % 4 WHEN 2 THEN 'part ' WHEN 3 THEN 'Nowhere:part ' ELSE 'Part ' END || (c_custkey % 1000)""",
)
def jn11(spark, d):
    key = F.col("c_custkey")
    prefix = F.when(key % 4 == 1, "Kategorie:part ").when(key % 4 == 2, "Gadget:part ").when(key % 4 == 3, "Nowhere:part ").otherwise("part ")
    titles = table(spark, d, "customer").select(F.lit("tpch").alias("db_name"), key.alias("id"), F.concat(prefix, key % 1000).alias("target"))
    return lookups.pages_by_qualified_titles(pages(spark, d), namespaces(spark), titles).select("id", "page_id")


# Tiers


@query("tt9_new_tiers", f"SELECT page_id, TIMESTAMP '1995-06-01' AS ts FROM ({PAGES_SQL}) WHERE page_id NOT IN (SELECT l_partkey FROM lineitem WHERE date_trunc('month', l_shipdate) = TIMESTAMP '1995-06-01')")
def tt9(spark, d):
    known = table(spark, d, "lineitem").select(F.col("l_partkey").alias("page_id"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts"))
    return history.new_tiers(known, pages(spark, d), "1995-06-01 00:00:00")


@query("tt10_tiers_in_order", "SELECT page_id, ts, row_number() OVER (ORDER BY page_id, ts) AS place FROM (SELECT DISTINCT user_id AS page_id, ts FROM events)")
def tt10(spark, d):
    found = revisions(spark, d).select("page_id", "ts").distinct()
    placed = numbering.numbered(found, ["page_id", "ts"], "place")
    return tiers.ordered_tiers(placed)


@query(
    "tt13_tier_attributes",
    "SELECT conv_id AS page_id, turn AS tier, CASE WHEN turn = 1 THEN 'changed' ELSE text END AS value, false AS value_error FROM conversations WHERE turn <> 2",
)
def tt13(spark, d):
    talk = table(spark, d, "conversations")
    values = talk.select(F.col("conv_id").alias("page_id"), F.timestamp_seconds(F.col("turn") * 86400).alias("ts"), F.col("text").alias("value"))
    stored = materialise(tiers.encoded(values, codecs.DELTA), "tiers")
    day = F.timestamp_seconds(F.lit(86400))
    new = values.where(F.col("ts") == day).withColumn("value", F.lit("changed"))
    gone = values.where(F.col("ts") == F.timestamp_seconds(F.lit(2 * 86400))).withColumn("value", F.lit(None).cast("string"))
    read = tiers.attribute(materialise(tiers.set_attribute(stored, new.unionByName(gone)), "tiers"))
    return read.select("page_id", (F.unix_seconds("ts") / 86400).cast("long").alias("tier"), "value", "value_error")


@query("prj1_page_columns", f"SELECT page_id, ns_id, title FROM ({PAGES_SQL})")
def prj1(spark, d):
    return pages(spark, d).select("page_id", "ns_id", "title")


@query("prj4_has_attribute", "SELECT page_id, html IS NOT NULL AND page_id % 3 <> 1 AS has_html FROM pages")
def prj4(spark, d):
    html = F.when(F.col("page_id") % 3 != 1, F.col("html"))
    return table(spark, d, "pages").select("page_id", tiers.has_attribute(html).alias("has_html"))


# Compression


@query("cmp3_codecs_by_name", "SELECT doc_id, text FROM documents")
def cmp3(spark, d):
    docs, out = table(spark, d, "documents"), None
    for i, codec in enumerate(codecs.CODECS):
        own = docs.where(F.pmod("doc_id", F.lit(len(codecs.CODECS))) == i).select("doc_id", F.lit(codec).alias("codec"), codecs.compress(F.col("text"), codec).alias("data"))
        out = own if out is None else out.unionByName(own)
    return out.select("doc_id", codecs.uncompress(F.col("data"), F.col("codec")).alias("text"))


@query("cmp7_html_chain", "SELECT conv_id AS page_id, turn AS revision_id, CASE WHEN turn % 5 <> 3 THEN '<p>' || text || '</p>' END AS html, turn % 5 = 3 AS html_error, false AS text_error FROM conversations")
def cmp7(spark, d):
    html = F.when(F.col("revision_id") % 5 != 3, F.concat(F.lit("<p>"), "text", F.lit("</p>")))
    stored = codecs.compress_rendered(turns(spark, d).select("page_id", "revision_id", "ts", html.alias("html")), interval=4)
    return codecs.decode_history(stored, "html").select("page_id", "revision_id", "html", "html_error", "text_error")


# Texts


@query("html5_redirect_target", r"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS target FROM customer")
def html5(spark, d):
    key = F.col("c_custkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("#REDIRECT [[ "), "c_name", F.lit(" ]] [[x]]"))).when(key % 3 == 1, F.concat(F.lit("#redirect: see\n[["), "c_mktsegment", F.lit("]]"))).otherwise(F.concat(F.lit("see #REDIRECT [["), "c_name", F.lit("]]")))
    return table(spark, d, "customer").select("c_custkey", X.wiki_redirect_target(text).alias("target"))


@query("en1_decoded_names", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'WIKITEXT' WHEN 1 THEN 'CSS' WHEN 2 THEN 'UNKNOWN' ELSE 'WIKITEXT' END AS model, CASE event_id % 2 WHEN 0 THEN 'FIRST_LETTER' ELSE 'CASE_SENSITIVE' END AS \"case\" FROM events")
def en1(spark, d):
    key = F.col("event_id")
    model = F.when(key % 4 == 0, "wikitext").when(key % 4 == 1, "css").when(key % 4 == 2, "odd")
    case = F.when(key % 2 == 0, "first-letter").otherwise("case-sensitive")
    return table(spark, d, "events").select("event_id", X.decoded(X.MODELS, model, "WIKITEXT", "UNKNOWN").alias("model"), X.decoded(X.CASES, case, None, None).alias("case"))


@query(
    "html4_templates_at",
    f"""WITH r AS (SELECT title, revision_id, ts, text FROM ({REVISIONS_SQL}) JOIN (SELECT p_partkey AS page_id, 'T' || p_partkey AS title FROM part WHERE p_size % 3 = 1) USING (page_id))
    SELECT title, coalesce(max_by(text, (ts, revision_id)) FILTER (ts <= TIMESTAMP '1994-06-01'), min_by(text, (ts, revision_id))) AS body FROM r GROUP BY title""",
)
def html4(spark, d):
    part = table(spark, d, "part")
    own = part.select(F.col("p_partkey").alias("page_id"), F.when(F.col("p_size") % 3 == 1, 10).otherwise(0).alias("ns_id"), F.concat(F.lit("T"), "p_partkey").alias("title"))
    return rendering.templates_at(own, item_revisions(spark, d), "1994-06-01 00:00:00")
