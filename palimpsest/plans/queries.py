"""Queries of the wiki engine over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import codecs, markup
from palimpsest.functions import text as X
from palimpsest.operators import evaluation, graph, history, layers, links, lookups, numbering
from palimpsest.plans.adapters import ARTICLE_LINKS_SQL, CATEGORY_LINKS_SQL, article_links, category_links, revisions, table, turns
from palimpsest.plans.registry import query
from palimpsest.sources import delta_store, exports
from palimpsest.storage import materialise, scratch

AT = "2024-01-15 00:00:00"
MANY = ("2024-01-05 00:00:00", "2024-01-15 00:00:00", "2024-01-25 12:00:00")
LAYER = "1996-03-01 00:00:00"
EVENTS = "SELECT user_id AS page_id, event_id AS revision_id, ts FROM events"


# Time travel


@query("tt1_revision_at", f"SELECT user_id AS page_id, event_id AS revision_id, ts FROM events WHERE ts <= TIMESTAMP '{AT}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def tt1(spark, d):
    return history.revision_at(revisions(spark, d).select("page_id", "revision_id", "ts"), AT)


@query("tt12_snapshot_at", f"SELECT user_id AS page_id, max_by(event_id, (ts, event_id)) AS revision_id FROM events WHERE ts <= TIMESTAMP '{AT}' GROUP BY user_id")
def tt12(spark, d):
    return history.revision_at(revisions(spark, d).select("page_id", "revision_id", "ts"), AT).select("page_id", "revision_id")


@query(
    "tt12_snapshot_many",
    f"""WITH t("at") AS (VALUES {", ".join(f"(TIMESTAMP '{x}')" for x in MANY)})
    SELECT user_id AS page_id, event_id AS revision_id, "at" FROM events, t WHERE ts <= "at"
    QUALIFY row_number() OVER (PARTITION BY user_id, "at" ORDER BY ts DESC, event_id DESC) = 1""",
)
def tt12_many(spark, d):
    instants = spark.createDataFrame([(x,) for x in MANY], "at string")
    return history.snapshots(revisions(spark, d).select("page_id", "revision_id", "ts"), instants).select("page_id", "revision_id", "at")


@query(
    "jn9_as_of_requests",
    f"""WITH q AS (SELECT event_id, (user_id * 7 + event_id) % (SELECT max(user_id) + 5 FROM events) AS page_id, ts - INTERVAL 3 HOUR AS "at" FROM events
      UNION ALL SELECT -event_id, (SELECT min(user_id) FROM events), ts FROM events)
    SELECT q.event_id AS request, q.page_id, max_by(e.event_id, (e.ts, e.event_id)) AS revision_id, max_by(e.event_type, (e.ts, e.event_id)) AS author, max(e.ts) AS ts
    FROM q LEFT JOIN events e ON e.user_id = q.page_id AND e.ts <= "at" GROUP BY 1, 2""",
)
def jn9(spark, d):
    """Every event asks about a page three hours before, and about the first page at its own time; that page has half of all requests."""
    events = table(spark, d, "events")
    bounds = events.agg((F.max("user_id") + 5).alias("n"), F.min("user_id").alias("first"))  # one row
    asked = events.join(F.broadcast(bounds), F.lit(True)).select("event_id", "user_id", "ts", "n", "first")
    spread = asked.select(F.col("event_id").alias("request"), ((F.col("user_id") * 7 + F.col("event_id")) % F.col("n")).alias("page_id"), (F.col("ts") - F.expr("INTERVAL 3 HOURS")).alias("at"))
    hot = asked.select((-F.col("event_id")).alias("request"), F.col("first").alias("page_id"), F.col("ts").alias("at"))
    found = history.revision_as_of(spread.unionByName(hot), revisions(spark, d), columns=("revision_id", "author", "ts"))
    return found.select("request", "page_id", "revision_id", "author", "ts")


@query("tt2_first_revision", "SELECT user_id AS page_id, min_by(event_id, (ts, event_id)) AS revision_id FROM events GROUP BY user_id")
def tt2(spark, d):
    return history.first_revision(revisions(spark, d).select("page_id", "revision_id", "ts")).select("page_id", "revision_id")


@query("tt3_latest_revision", "SELECT user_id AS page_id, max_by(event_id, (ts, event_id)) AS revision_id FROM events GROUP BY user_id")
def tt3(spark, d):
    return history.latest_revision(revisions(spark, d).select("page_id", "revision_id", "ts")).select("page_id", "revision_id")


@query("tt4_positions", f"SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY page_id) AS cnt FROM ({EVENTS}) WINDOW w AS (PARTITION BY page_id ORDER BY ts, revision_id)")
def tt4(spark, d):
    return history.positions(revisions(spark, d).select("page_id", "revision_id", "ts")).withColumn("rn", F.col("rn").cast("long"))


@query(
    "tt6_sequence_from",
    "SELECT conv_id AS page_id, turn AS revision_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, text FROM conversations c WHERE turn >= 2 AND EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.turn = 2)",
)
def tt6(spark, d):
    rows = turns(spark, d)
    return history.sequence_from(rows, rows.where("revision_id = 2")).select("page_id", "revision_id", F.col("rn").cast("long"), "text")


@query(
    "tt7_prev_next",
    "SELECT conv_id AS page_id, turn AS revision_id, lag(turn) OVER w AS previous_id, lead(turn) OVER w AS next_id, (length(text) - lag(length(text)) OVER w)::BIGINT AS growth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def tt7(spark, d):
    rows = history.neighbours(turns(spark, d)).withColumn("growth", F.length("text") - F.lag(F.length("text")).over(history.chronology()))
    return rows.select("page_id", "revision_id", "previous_id", "next_id", F.col("growth").cast("long"))


@query("tt8_interval", f"SELECT page_id, revision_id, ts AS valid_from, coalesce(lead(ts) OVER (PARTITION BY page_id ORDER BY ts, revision_id), TIMESTAMP '3000-01-01') AS valid_to FROM ({EVENTS})")
def tt8(spark, d):
    return history.intervals(revisions(spark, d)).select("page_id", "revision_id", "valid_from", "valid_to")


@query("tt14_key_frames", f"SELECT page_id, revision_id, (rn - 1) % 50 = 0 OR rn = cnt AS is_key FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ts, revision_id) AS rn, count(*) OVER (PARTITION BY page_id) AS cnt FROM ({EVENTS}))")
def tt14(spark, d):
    return history.key_frames(revisions(spark, d)).select("page_id", "revision_id", "is_key")


@query("ag1_revision_count", "SELECT user_id AS page_id, count(*) AS n_revisions FROM events GROUP BY user_id")
def ag1(spark, d):
    return history.revision_counts(revisions(spark, d))


@query("ag2_pages_by_namespace", "SELECT n_regionkey AS ns_id, count(*) AS n_pages FROM nation GROUP BY 1")
def ag2(spark, d):
    return lookups.pages_by_namespace(table(spark, d, "nation").select(F.col("n_regionkey").alias("ns_id")))


@query("jn5_parent", "SELECT c.conv_id, c.turn, p.role AS parent_role FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def jn5(spark, d):
    talk = table(spark, d, "conversations").withColumn("parent_id", F.col("turn") - 1).select(F.col("conv_id").alias("db"), F.col("turn").alias("revision_id"), "parent_id", F.col("role").alias("ts"))
    return history.with_parent(talk, ("db",)).select(F.col("db").alias("conv_id"), F.col("revision_id").alias("turn"), F.col("parent_ts").alias("parent_role"))


@query("jn10_tier_exact", "SELECT user_id AS page_id, ts FROM events WHERE (user_id, ts) IN (SELECT (user_id, ts) FROM events WHERE value > 50)")
def jn10(spark, d):
    wanted = table(spark, d, "events").where("value > 50").select(F.col("user_id").alias("page_id"), "ts")
    return history.tiers_at(revisions(spark, d).select("page_id", "ts"), wanted)


@query("jn13_skip_existing", "SELECT o_orderkey AS page_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < TIMESTAMP '1996-06-01')")
def jn13(spark, d):
    known = table(spark, d, "lineitem").where(F.col("l_shipdate") < F.lit("1996-06-01").cast("timestamp_ntz")).select(F.col("l_orderkey").alias("page_id"))
    return lookups.unknown(table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id")), known, ["page_id"])


# Projections and look-ups


@query("prj2_author", "SELECT event_id AS revision_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'ip' || event_id END, c_name) AS author FROM events LEFT JOIN customer ON c_custkey = user_id")
def prj2(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("revision_id"), F.col("user_id").alias("contributor_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("ip"), F.col("event_id"))).alias("ip"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("contributor_id"), F.col("c_name").alias("name"))
    return history.with_author(rows, people).select("revision_id", "author")


@query("prj3_bytes", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN n_chars END, strlen(text))::BIGINT AS bytes FROM documents")
def prj3(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", history.byte_length(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")), F.col("text")).cast("long").alias("bytes"))


NAMESPACES = [(0, "FIRST_LETTER", [""]), (14, "FIRST_LETTER", ["Category", "Kategorie"]), (2302, "CASE_SENSITIVE", ["Gadget"])]


@query(
    "flt6_qualified_title",
    """WITH n AS (SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN 'Category:' WHEN 1 THEN 'Gadget:' WHEN 2 THEN 'Nowhere:' WHEN 3 THEN 'Kategorie:' ELSE '' END || lower(n_name) AS target FROM nation)
    SELECT id, (CASE id % 5 WHEN 0 THEN 14 WHEN 1 THEN 2302 WHEN 3 THEN 14 ELSE 0 END)::INTEGER AS target_ns,
    CASE WHEN id % 5 = 1 THEN substr(target, 8) WHEN id % 5 = 0 THEN upper(substr(target, 10, 1)) || substr(target, 11) WHEN id % 5 = 3 THEN upper(substr(target, 11, 1)) || substr(target, 12)
    ELSE upper(substr(target, 1, 1)) || substr(target, 2) END AS target_title FROM n""",
)
def flt6(spark, d):
    key = F.col("n_nationkey")
    prefix = F.when(key % 5 == 0, "Category:").when(key % 5 == 1, "Gadget:").when(key % 5 == 2, "Nowhere:").when(key % 5 == 3, "Kategorie:").otherwise("")
    rows = table(spark, d, "nation").select(key.alias("id"), F.concat(prefix, F.lower("n_name")).alias("target"))
    names = spark.createDataFrame(NAMESPACES, "ns_id int, case string, all_names array<string>")
    return links.split_namespace(rows, names).select("id", "target_ns", "target_title")


@query("flt10_namespace_scan", "SELECT n_nationkey AS page_id, n_name AS title FROM nation WHERE n_regionkey IN (1, 3)")
def flt10(spark, d):
    pages = table(spark, d, "nation").select(F.col("n_nationkey").alias("page_id"), F.col("n_name").alias("title"), F.col("n_regionkey").alias("ns_id"))
    return lookups.in_namespaces(pages, (1, 3)).select("page_id", "title")


# Links

ANCHORS_SQL = r"""SELECT page_id, unnest(range(1, len(h) + 1)) AS k, unnest(h) AS href
    FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '<!--[^\n]*?-->', '', 'g'), '<a[ ][^>]*?href="([^">]+)', 1) AS h FROM pages)"""


@query("html1_anchors", f"SELECT page_id, k::INTEGER AS k, href FROM ({ANCHORS_SQL})")
def html1_anchors(spark, d):
    return links.anchors(table(spark, d, "pages").select("page_id", "html")).select("page_id", "k", "href")


@query("html1_targets", f"SELECT DISTINCT page_id, url_decode(replace(replace(substr(split_part(href, '#', 1), 2), '_', ' '), '+', ' ')) AS target FROM ({ANCHORS_SQL}) WHERE href LIKE '/_%'")
def html1_targets(spark, d):
    found = links.anchors(table(spark, d, "pages").select("page_id", "html"))
    return found.select("page_id", links.local_target(F.col("href"), "/").alias("target")).where("target IS NOT NULL").distinct()


@query("set1_distinct_links", f"SELECT DISTINCT * FROM ({ARTICLE_LINKS_SQL})")
def set1(spark, d):
    return links.distinct_links(article_links(spark, d))


@query("gr1_links_out_at", f"SELECT * FROM ({ARTICLE_LINKS_SQL}) WHERE ts = TIMESTAMP '{LAYER}' AND source_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND link_type = 'ARTICLE'")
def gr1_out(spark, d):
    pages = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("page_id"))
    return links.links_out(article_links(spark, d), pages, LAYER, ("ARTICLE",))


@query("gr1_links_in_at", f"SELECT * FROM ({ARTICLE_LINKS_SQL}) WHERE ts = TIMESTAMP '{LAYER}' AND target_id IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def gr1_in(spark, d):
    pages = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("page_id"))
    return links.links_in(article_links(spark, d), pages, LAYER)


@query("ag3_targets_by_type", f"SELECT source_id, link_type, count(DISTINCT target_id) AS n, min(target_id) AS first, max(target_id) AS last FROM ({ARTICLE_LINKS_SQL}) GROUP BY ALL")
def ag3(spark, d):
    rows = links.targets_by_type(article_links(spark, d))
    return rows.select("source_id", "link_type", F.size("targets").cast("long").alias("n"), F.element_at("targets", 1).alias("first"), F.element_at("targets", -1).alias("last"))


@query("ag4_layers", f"SELECT source_id, target_id, link_type, count(DISTINCT ts) AS n_layers, min(ts) AS first_layer FROM ({ARTICLE_LINKS_SQL}) GROUP BY ALL")
def ag4(spark, d):
    return links.layers_of_edges(article_links(spark, d)).select("source_id", "target_id", "link_type", F.size("layers").cast("long").alias("n_layers"), F.element_at("layers", 1).alias("first_layer"))


#: Suppliers' links to part sizes, by month: few edges, each in many layers.
DENSE_SQL = """SELECT l_suppkey AS source_id, p_size::BIGINT AS target_id, CASE l_returnflag WHEN 'A' THEN 'REDIRECT' WHEN 'R' THEN 'CATEGORIZATION' ELSE 'ARTICLE' END AS link_type,
      date_trunc('month', l_shipdate)::TIMESTAMP AS ts FROM lineitem JOIN part ON p_partkey = l_partkey"""


def _dense_links(spark, d):
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("target_id"))
    rows = table(spark, d, "lineitem").join(sizes, "l_partkey")
    kind = F.when(F.col("l_returnflag") == "A", "REDIRECT").when(F.col("l_returnflag") == "R", "CATEGORIZATION").otherwise("ARTICLE")
    return rows.select(F.col("l_suppkey").alias("source_id"), "target_id", kind.alias("link_type"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts"))


RUNS_SQL = f"""WITH l AS (SELECT DISTINCT * FROM ({DENSE_SQL})), n AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k FROM (SELECT DISTINCT ts FROM l)),
    g AS (SELECT l.*, k, k - row_number() OVER (PARTITION BY source_id, target_id, link_type ORDER BY k) AS island FROM l JOIN n USING (ts))
    SELECT source_id, target_id, link_type, min(ts) AS first_layer, max(ts) AS last_layer, count(*) AS n_layers FROM g GROUP BY source_id, target_id, link_type, island"""


@query("ag4_layer_runs", RUNS_SQL)
def ag4_runs(spark, d):
    return layers.runs(_dense_links(spark, d))


@query("gr4_merged_runs", RUNS_SQL)
def gr4_runs(spark, d):
    """Runs over every third layer, into which the other layers are merged in two imports."""
    rows = _dense_links(spark, d)
    part = lambda k: rows.where(F.month("ts") % 3 == k)
    known, stored = layers.layer_list(part(1)), layers.runs(part(1))
    for k in (0, 2):
        stored = materialise(layers.merged_runs(stored, known, part(k)), "runs")
        known = known.unionByName(layers.layer_list(part(k)))
    return stored


@query("jn7_layer_of_runs", f"SELECT DISTINCT * FROM ({DENSE_SQL}) WHERE ts = TIMESTAMP '{LAYER}' AND link_type = 'ARTICLE'")
def jn7_runs(spark, d):
    return layers.edges_at(layers.runs(_dense_links(spark, d)), LAYER, ("ARTICLE",))


@query("ag6_types_of_runs", f"SELECT DISTINCT link_type, ts FROM ({DENSE_SQL})")
def ag6_runs(spark, d):
    rows = _dense_links(spark, d)
    return layers.layer_types(layers.runs(rows), layers.layer_list(rows))


@query("ag5_layers_sorted", f"SELECT DISTINCT ts FROM ({ARTICLE_LINKS_SQL})")
def ag5(spark, d):
    return links.layers(article_links(spark, d)).select("ts").distinct().orderBy("ts")


@query("ag6_layer_types", f"SELECT DISTINCT link_type, ts FROM ({ARTICLE_LINKS_SQL})")
def ag6(spark, d):
    return links.layers(article_links(spark, d))


@query("jn8_entities_by_aspect", "SELECT user_id AS page_id, event_type AS aspect, string_agg(event_id::VARCHAR, ',' ORDER BY event_id::VARCHAR) AS entities FROM events GROUP BY ALL")
def jn8(spark, d):
    usage = table(spark, d, "events").select(F.col("user_id").alias("page_id"), F.col("event_type").alias("aspect"), F.col("event_id").cast("string").alias("entity_id"))
    return links.entities_by_aspect(usage).select("page_id", "aspect", F.array_join("entities", ",").alias("entities"))


@query("jn12_target_exists", f"SELECT l.* FROM ({ARTICLE_LINKS_SQL}) l JOIN (SELECT l_partkey, min(l_shipdate) AS born FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) b ON l_partkey = target_id AND born <= ts")
def jn12(spark, d):
    born = table(spark, d, "lineitem").where("l_linenumber > 1").select(F.col("l_partkey").alias("page_id"), F.col("l_shipdate").alias("ts"))
    return links.targets_existing(article_links(spark, d), born)


# Graph


@query("gr6_category_direct", f"SELECT DISTINCT source_id AS page_id FROM ({CATEGORY_LINKS_SQL}) WHERE target_id IN (102, 103, 1)")
def gr6(spark, d):
    return graph.category_members(category_links(spark, d), spark.createDataFrame([(102,), (103,), (1,)], "page_id long"))


@query(
    "gr7_category_closure",
    f"""WITH RECURSIVE e AS ({CATEGORY_LINKS_SQL}), r AS (SELECT 1::BIGINT AS page_id UNION SELECT e.source_id FROM e JOIN r ON e.target_id = r.page_id)
    SELECT page_id FROM r WHERE page_id <> 1""",
)
def gr7(spark, d):
    return graph.category_closure(category_links(spark, d), spark.createDataFrame([(1,)], "page_id long")).select("page_id")


@query("jn14_subgraph", f"SELECT * FROM ({ARTICLE_LINKS_SQL}) WHERE source_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND target_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def jn14(spark, d):
    nodes = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("page_id"))
    return graph.induced(article_links(spark, d), nodes)


@query(
    "ag7_link_evaluation",
    """WITH k AS (SELECT DISTINCT l_orderkey AS page_id, CASE l_returnflag WHEN 'A' THEN 'REDIRECT' WHEN 'R' THEN 'CATEGORIZATION' ELSE 'ARTICLE' END AS link_type, l_partkey AS target_id,
      l_discount < 0.06 AS g, l_tax < 0.05 AS t FROM lineitem),
    e AS (SELECT page_id, link_type, target_id, max(g::INT) AS g, max(t::INT) AS t FROM k GROUP BY ALL),
    s AS (SELECT page_id, link_type, sum(g) AS ng, sum(t) AS nt, sum(g * t) AS nb FROM e GROUP BY ALL),
    grid AS (SELECT o_orderkey AS page_id, x.link_type FROM orders, (VALUES ('ARTICLE'), ('REDIRECT'), ('CATEGORIZATION')) x(link_type)),
    v AS (SELECT grid.link_type, page_id, CASE WHEN coalesce(ng, 0) = 0 THEN 1.0::DOUBLE ELSE nb / ng END AS r, CASE WHEN coalesce(nt, 0) = 0 THEN 1.0::DOUBLE ELSE nb / nt END AS p FROM grid LEFT JOIN s USING (page_id, link_type))
    SELECT link_type, round(avg(r), 6) AS recall, round(avg(p), 6) AS precision, round(avg(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END), 6) AS f_score, count(*) AS page_count FROM v GROUP BY 1""",
)
def ag7(spark, d):
    items = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "REDIRECT").when(F.col("l_returnflag") == "R", "CATEGORIZATION").otherwise("ARTICLE")
    edges = items.select(F.col("l_orderkey").alias("page_id"), kind.alias("link_type"), F.col("l_partkey").alias("target_id"), "l_discount", "l_tax")
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"))
    scores = evaluation.link_evaluation(pages, edges.where("l_discount < 0.06D"), edges.where("l_tax < 0.05D"))
    return scores.select("link_type", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f_score")], "page_count")


# Text functions


@query("txt4_xml_escape", """SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents""")
def txt4(spark, d):
    return table(spark, d, "documents").select("doc_id", X.xml_escape(F.col("text")).alias("escaped"))


@query("txt6_control", r"SELECT doc_id, regexp_replace(text, '[\x00-\x1F\x7F-\x{9F}]', '', 'g') AS cleaned FROM documents")
def txt6(spark, d):
    return table(spark, d, "documents").select("doc_id", X.without_control(F.col("text")).alias("cleaned"))


@query("snk7_graph_escape", "SELECT doc_id, translate(text, '[]¤' || chr(9) || chr(13) || chr(10), '()    ') AS escaped FROM documents")
def snk7(spark, d):
    return table(spark, d, "documents").select("doc_id", X.graph_escape(F.col("text")).alias("escaped"))


TERMS_SQL = r"""SELECT conv_id, turn, term, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[ \t\n\v\f\r]+')) AS term FROM conversations) WHERE term <> '' GROUP BY ALL"""


@query(
    "txt9_cosine",
    f"""WITH c AS ({TERMS_SQL}), q AS (SELECT conv_id, turn, sum(n * n) AS q FROM c GROUP BY ALL)
    SELECT t.conv_id, t.turn, round(coalesce(any_value(dot) / (sqrt(any_value(x.q)) * sqrt(any_value(y.q))), 0), 6) AS cosine
    FROM (SELECT DISTINCT b.conv_id, b.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) t
    LEFT JOIN (SELECT b.conv_id, b.turn, sum(a.n * b.n) AS dot FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.term = b.term GROUP BY ALL) d USING (conv_id, turn)
    LEFT JOIN q y ON y.conv_id = t.conv_id AND y.turn = t.turn LEFT JOIN q x ON x.conv_id = t.conv_id AND x.turn = t.turn - 1 GROUP BY ALL""",
)
def txt9(spark, d):
    talk = table(spark, d, "conversations")
    keys = talk.select("conv_id", "turn").distinct()
    terms = keys.join(lookups.term_counts(talk, ["conv_id", "turn"]), ["conv_id", "turn"], "left").withColumn("terms", F.coalesce("terms", F.create_map().cast("map<string,int>")))
    before = terms.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("terms").alias("before"))
    return terms.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.term_cosine(F.col("before"), F.col("terms")), 6).alias("cosine"))


@query("ag9_term_counts", TERMS_SQL)
def ag9(spark, d):
    counted = lookups.term_counts(table(spark, d, "conversations"), ["conv_id", "turn"])
    return counted.select("conv_id", "turn", F.explode("terms").alias("term", "n")).withColumn("n", F.col("n").cast("long"))


@query("set4_token_union", r"""SELECT conv_id, count(DISTINCT term) AS n_terms FROM (SELECT conv_id, unnest(regexp_split_to_array(text, '[ \t\n\v\f\r]+')) AS term FROM conversations) WHERE term <> '' GROUP BY 1""")
def set4(spark, d):
    counted = lookups.term_counts(table(spark, d, "conversations"), ["conv_id", "turn"])
    return lookups.token_union(counted, ["conv_id"]).select("conv_id", F.size("tokens").cast("long").alias("n_terms"))


@query(
    "txt10_alphanumeric",
    r"""SELECT doc_id, count(*) FILTER (regexp_full_match(w, '[\p{L}\p{Nd}]+')) AS whole, count(*) FILTER (regexp_matches(w, '[\p{L}\p{Nd}]')) AS some
    FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY doc_id""",
)
def txt10(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ", -1)).alias("w"))
    return words.groupBy("doc_id").agg(F.count_if(X.is_alphanumeric(F.col("w"))).alias("whole"), F.count_if(X.has_alphanumeric(F.col("w"))).alias("some"))


@query("txt12_title", "SELECT p_partkey, upper(substr(lower(p_name), 1, 1)) || substr(lower(p_name), 2) AS title FROM part")
def txt12(spark, d):
    return table(spark, d, "part").select("p_partkey", X.first_upper(F.lower("p_name")).alias("title"))


# Codecs, markup and exports


def _round_trip(codec: str):
    def run(spark, d):
        docs = table(spark, d, "documents").withColumn("data", codecs.compress(F.col("text"), codec))
        return docs.select("doc_id", codecs.uncompress(F.col("data"), F.lit(codec)).alias("text"))

    return run


for _codec in codecs.CODECS:
    query(f"cmp_round_trip_{_codec.lower()}", "SELECT doc_id, text FROM documents")(_round_trip(_codec))


@query("cmp5_delta_chain", "SELECT conv_id AS page_id, turn AS revision_id, text, false AS text_error FROM conversations")
def cmp5(spark, d):
    stored = codecs.compress_history(turns(spark, d))
    return codecs.decode_history(stored).select("page_id", "revision_id", "text", "text_error")


@query("cmp6_chosen_revisions", "SELECT conv_id AS page_id, turn AS revision_id, text, false AS text_error FROM conversations WHERE (conv_id + turn) % 3 = 0")
def cmp6(spark, d):
    """A stored history of which some revisions of every page are read."""
    rows, folder = turns(spark, d), scratch(spark, "delta-store")
    delta_store.write(rows, folder, interval=4)
    wanted = rows.where((F.col("page_id") + F.col("revision_id")) % 3 == 0)
    return delta_store.read(spark, folder, wanted).select("page_id", "revision_id", "text", "text_error")


@query(
    "cmp5_delta_sizes",
    """SELECT conv_id AS page_id, count(*) FILTER (rn % 4 <> 1 AND rn < cnt) AS deltas, count(*) FILTER (rn % 4 = 1 OR rn = cnt) AS full_texts, true AS deltas_small
    FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS cnt FROM conversations) GROUP BY 1""",
)
def cmp5_sizes(spark, d):
    """Revisions that each add a turn to a long line: how many are deltas, and that each is smaller than its turn and a margin."""
    rows = turns(spark, d)
    line = F.repeat(F.concat(F.lit("common words of page "), F.col("page_id"), F.lit(" ")), 200)
    grown = rows.withColumn("size", F.octet_length("text")).withColumn("text", F.concat(line, F.col("text"), F.lit(" "), line))
    stored = codecs.compress_history(grown, interval=4)
    delta = F.col("codec") == codecs.DELTA
    before = F.coalesce(F.max("size").over(history.chronology().rowsBetween(-1, 0)), F.lit(0))
    sized = stored.withColumn("most", before)
    return sized.groupBy("page_id").agg(F.count_if(delta).alias("deltas"), F.count_if(~delta).alias("full_texts"), F.coalesce(F.every(F.when(delta, F.octet_length("data") < 2 * F.col("most") + 400)), F.lit(True)).alias("deltas_small"))


@query("ag8_compression_statistics")
def ag8(spark, d):
    rows = turns(spark, d)
    stored = codecs.compress_history(rows).join(rows.select("page_id", "revision_id", F.octet_length("text").alias("raw_bytes")), ["page_id", "revision_id"])
    return evaluation.compression_statistics(stored.select("raw_bytes", F.octet_length("data").alias("stored_bytes"), "codec"))


@query("html3_render")
def html3(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", markup.rendered(F.concat(F.lit("Document "), F.col("doc_id")), F.col("text"), F.lit(None).cast("map<string,string>")).alias("html"))


#: Entities that the tables' pages use.
ENTITIES = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&amp;": "&"}
PLAIN_SQL = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _entity, _character in ENTITIES.items():
    PLAIN_SQL = f"replace({PLAIN_SQL}, '{_entity}', '{_character}')"


@query("html6_plain_text", f"SELECT page_id, trim(regexp_replace({PLAIN_SQL}, '\\s+', ' ', 'g')) AS text FROM pages")
def html6(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query("txt1_tei")
def txt1(spark, d):
    ids = F.create_map(F.lit("pageID"), F.col("page_id").cast("string"), F.lit("pageURL"), F.col("url"))
    return table(spark, d, "pages").select("page_id", markup.tei(F.col("html"), F.lit(None).cast("string"), ids).alias("tei"))


@query("txt2_tei_flat")
def txt2(spark, d):
    ids = F.create_map(F.lit("pageID"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", markup.tei(F.col("html"), F.col("url"), ids, flat=True).alias("tei"))


@query("txt5_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, epoch_us(ts) // 1000 AS millis FROM events")
def txt5(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", X.iso_instant(ts).alias("iso"), X.epoch_millis(ts).alias("millis"))


@query(
    "txt7_common_substring",
    """WITH p AS (SELECT p_partkey, p_name AS a, p_name || p_type AS b, lower(p_type) || p_brand || substr(p_name, 3) AS c FROM part), s AS (SELECT p_partkey, c, b, i, n FROM p, range(1, 40) x(i), range(1, 40) y(n) WHERE i + n - 1 <= length(b))
    SELECT p.p_partkey, coalesce(max_by(substr(s.b, i, n), (n, -i)), '') AS common FROM p LEFT JOIN s ON s.p_partkey = p.p_partkey AND contains(s.c, substr(s.b, i, n)) GROUP BY 1""",
)
def txt7(spark, d):
    return table(spark, d, "part").select("p_partkey", X.longest_common_substring(F.concat("p_name", "p_type"), F.concat(F.lower("p_type"), "p_brand", F.substr("p_name", F.lit(3)))).alias("common"))


@query("txt8_quote_doubled", "SELECT doc_id, replace(text, '''', '''''') AS quoted FROM documents")
def txt8(spark, d):
    return table(spark, d, "documents").select("doc_id", X.quote_doubled(F.col("text")).alias("quoted"))


@query("txt11_number", r"SELECT doc_id, count(*) FILTER (try_cast(w AS DOUBLE) IS NOT NULL) AS numbers FROM (SELECT doc_id, unnest(list_append(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), n_chars::VARCHAR)) AS w FROM documents WHERE text IS NOT NULL) GROUP BY doc_id")
def txt11(spark, d):
    words = F.array_append(F.split("text", r"[ \t\n\x0B\f\r]+"), F.col("n_chars").cast("string"))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(words).alias("w"))
    return rows.groupBy("doc_id").agg(F.count_if(X.is_number(F.col("w"))).alias("numbers"))


def _nation_tiers(spark, d):
    ts = F.lit("3000-01-01").cast("timestamp_ntz").alias("ts")
    nodes = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("page_id"), F.lit(14).alias("ns_id"), F.concat(F.lit("a & [b] ¤ "), "n_name").alias("title"))
    return nodes.unionByName(table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("page_id"), F.lit(0).alias("ns_id"), F.col("r_name").alias("title"))).select("page_id", ts, "ns_id", "title")


def _nation_edges(spark, d):
    """Category links among nations and regions, and those of customers and suppliers, whose pages are no nodes; nations also point to customers."""
    links_ = category_links(spark, d)
    return links_.unionByName(links_.where("source_id < 1000").select("source_id", (F.col("target_id") + 5000).alias("target_id"), "link_type", "ts"))


GRAPH_SQL = f"""n AS (SELECT *, row_number() OVER (ORDER BY page_id) AS number FROM (
      SELECT n_nationkey::BIGINT + 100 AS page_id, 14 AS ns_id, 'a & [b] ¤ ' || n_name AS title FROM nation UNION ALL SELECT r_regionkey, 0, r_name FROM region)),
    l AS (SELECT * FROM ({CATEGORY_LINKS_SQL}) UNION ALL SELECT n_nationkey::BIGINT + 100, n_regionkey::BIGINT + 5000 FROM nation),
    e AS (SELECT s.number AS source, t.number AS target, row_number() OVER (ORDER BY s.number, l.target_id) AS edge FROM l JOIN n s ON s.page_id = l.source_id LEFT JOIN n t ON t.page_id = l.target_id)"""
GRAPHML_SQL = f"""WITH {GRAPH_SQL}
    {" UNION ALL ".join(f"SELECT '{x}' AS value" for x in (*exports.GRAPHML_HEAD, "</graphml>"))}
    UNION ALL SELECT '<node id="n' || number || '">' || chr(10) || '<data key="d0">' || replace(title, '&', '&amp;') || '</data>' || chr(10) || '<data key="d1">' || ns_id || '</data>' || chr(10)
      || '<data key="d2">' || page_id || '</data>' || chr(10) || '<data key="d3">3000-01-01T00:00:00Z[UTC]</data>' || chr(10) || '</node>' FROM n
    UNION ALL SELECT '<edge id="e' || edge || '" source="n' || source || '" target="n' || target || '">' || chr(10) || '<data key="d4">CATEGORIZATION</data>' || chr(10) || '</edge>' FROM e WHERE target IS NOT NULL"""
GRAPH_TEXT_SQL = f"""WITH {GRAPH_SQL}
    {" UNION ALL ".join(f"SELECT '{x}' AS value" for x in (*exports.GRAPH_TEXT_HEAD, "Edges:"))}
    UNION ALL SELECT 'n' || number || '¤[Title¤' || translate(title, '[]¤', '() ') || '¤]¤[NSID¤' || ns_id || '¤]¤[Timestamp¤3000-01-01T00:00:00Z(UTC)¤]¤' FROM n
    UNION ALL SELECT 'n' || source || '¤n' || target || '¤1.0¤[Type¤CATEGORIZATION¤]¤' FROM e WHERE target IS NOT NULL"""


@query("snk1_graphml", GRAPHML_SQL)
def snk1(spark, d):
    return exports.graphml(_nation_tiers(spark, d), _nation_edges(spark, d), ("CATEGORIZATION",))


@query("snk2_tier_graph", GRAPH_TEXT_SQL)
def snk2(spark, d):
    return exports.tier_graph_text(_nation_tiers(spark, d), _nation_edges(spark, d), ("CATEGORIZATION",))


@query("snk3_page_graph", GRAPH_TEXT_SQL)
def snk3(spark, d):
    return exports.page_graph_text(_nation_tiers(spark, d).drop("ts"), _nation_edges(spark, d), ("CATEGORIZATION",))


@query(
    "snk4_current_graph",
    f"""WITH v AS (SELECT user_id AS page_id, max_by(event_id, (ts, event_id)) AS revision_id, max(ts) AS ts FROM events GROUP BY 1),
    l AS (SELECT DISTINCT user_id AS source_id, (user_id * 7 + event_id) % 200 AS target_id FROM events)
    {" UNION ALL ".join(f"SELECT '{x}' AS value" for x in (*exports.GRAPH_TEXT_HEAD, "Edges:"))}
    UNION ALL SELECT page_id || '_' || revision_id || '¤[Title¤Page ' || page_id || '¤]¤[NSID¤' || page_id % 3 || '¤]¤[Timestamp¤' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
      || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE rtrim(strftime(ts, '.%f'), '0') END || 'Z(UTC)¤]¤' FROM v WHERE page_id % 3 < 2
    UNION ALL SELECT a.page_id || '_' || a.revision_id || '¤' || b.page_id || '_' || b.revision_id || '¤1.0¤[Type¤ARTICLE¤]¤' FROM l JOIN v a ON a.page_id = source_id JOIN v b ON b.page_id = target_id WHERE a.page_id % 3 < 2 AND b.page_id % 3 < 2""",
)
def snk4(spark, d):
    rows = revisions(spark, d)
    pages = rows.select("page_id").distinct().select("page_id", (F.col("page_id") % 3).cast("int").alias("ns_id"), F.concat(F.lit("Page "), "page_id").alias("title"))
    ends = rows.select(F.col("page_id").alias("source_id"), ((F.col("page_id") * 7 + F.col("revision_id")) % 200).alias("target_id")).distinct()
    edges = ends.withColumn("link_type", F.lit("ARTICLE")).withColumn("ts", F.lit("3000-01-01").cast("timestamp"))
    return exports.current_graph_text(pages, rows, edges, (0, 1))


@query("snk5_tei_corpus")
def snk5(spark, d):
    rows = table(spark, d, "pages").select("page_id", "html", F.lit("").alias("namespace"), F.col("url").alias("title"))
    return exports.tei_corpus(rows, ["page_id"])


@query("numbered_rows", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS number FROM events")
def numbered_rows(spark, d):
    return numbering.numbered(table(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "number")


@query("set3_common_links", f"SELECT source_id, target_id FROM ({ARTICLE_LINKS_SQL}) WHERE link_type = 'ARTICLE' INTERSECT SELECT source_id, target_id FROM ({ARTICLE_LINKS_SQL}) WHERE link_type = 'REDIRECT'")
def set3(spark, d):
    edges = article_links(spark, d)
    return links.of_types(edges, ("ARTICLE",)).select("source_id", "target_id").intersect(links.of_types(edges, ("REDIRECT",)).select("source_id", "target_id"))


@query("gr2_tier_links", f"SELECT l.* FROM ({ARTICLE_LINKS_SQL}) l WHERE ts = TIMESTAMP '{LAYER}' AND source_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def gr2(spark, d):
    tiers = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("page_id"), F.lit(LAYER).cast("timestamp_ntz").alias("ts"))
    return links.tier_links(article_links(spark, d), tiers)


@query("gr4_add_links", f"SELECT DISTINCT * FROM ({ARTICLE_LINKS_SQL}) ")
def gr4(spark, d):
    edges = article_links(spark, d)
    return links.add_links(links.of_types(edges, ("ARTICLE", "REDIRECT")), links.of_types(edges, ("REDIRECT", "CATEGORIZATION")))


@query("txt13_prefix_cut", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS title FROM part")
def txt13(spark, d):
    part = table(spark, d, "part")
    ns = F.when(F.col("p_size") % 2 == 0, 14).otherwise(0)
    joined = F.when(ns == 14, F.concat(F.lit("Category:"), F.col("p_type"))).otherwise(F.col("p_name"))
    return part.select("p_partkey", X.without_prefix(joined, ns).alias("title"))
