"""Graph and TEI exports as tables of text lines (SNK1-7, GR8 of the survey).

Lines are written as text files whose parts, in the order of their names, are the
document; no export gathers the graph in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.markup import tei
from palimpsest.functions.text import graph_escape, xml_escape, zoned_instant
from palimpsest.operators.history import latest_revision
from palimpsest.operators.links import at_layer, of_types
from palimpsest.operators.numbering import numbered
from palimpsest.schemas import SENTINEL_LAYER

# Head and foot lines of the graph formats.
GRAPHML_HEAD = (
    '<?xml version="1.0" encoding="utf-8"?>',
    '<graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://graphml.graphdrawing.org/xmlns http://graphml.graphdrawing.org/xmlns/1.0/graphml.xsd">',
    '<key id="d0" for="node" attr.name="title" attr.type="string"/>',
    '<key id="d1" for="node" attr.name="ns" attr.type="integer"/>',
    '<key id="d2" for="node" attr.name="articleID" attr.type="integer"/>',
    '<key id="d3" for="node" attr.name="timestamp" attr.type="string"/>',
    '<key id="d4" for="edge" attr.name="type" attr.type="string"/>',
)
GRAPH_TEXT_HEAD = (
    "directed",
    "SimilarityGraph",
    "Vertex Attributes:[Title¤String];[NSID¤Integer];[Timestamp¤String];",
    "Edge Attributes:[Type¤String];",
    "ProbabilityMassOfGraph: 0",
    "Vertices:",
)


def _lines(df: DataFrame, *lines: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1)


def _joined(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts)


def qualified_title(namespace: Column, title: Column) -> Column:
    """JN6: the namespace's name and a colon in front, unless it is empty."""
    return F.when(F.coalesce(namespace, F.lit("")) == "", title).otherwise(F.concat(namespace, F.lit(":"), title))


def tier_edges(links: DataFrame, nodes: DataFrame, types) -> DataFrame:
    """``source, target, link_type, edge``: numbers of nodes (``page_id, ts, number``) linked at their common instant.

    No types mean no edges here, unlike in link queries. ``edge`` counts the links of the nodes by (source, target page,
    type), those to pages outside included, which are then left out.
    """
    chosen = of_types(links, types) if types else links.limit(0)
    source = nodes.select(F.col("page_id").alias("source_id"), "ts", F.col("number").alias("source"))
    target = nodes.select(F.col("page_id").alias("target_id"), "ts", F.col("number").alias("target"))
    found = chosen.join(source, ["source_id", "ts"]).join(target, ["target_id", "ts"], "left").select("source", "target", "target_id", "link_type")
    return numbered(found, ["source", "target_id", "link_type"], "edge").where("target IS NOT NULL").select("source", "target", "link_type", "edge")


def graphml(tiers: DataFrame, links: DataFrame, types=()) -> DataFrame:
    """SNK1: tiers have ``page_id, ts, ns_id, title``; nodes are numbered by page and instant. A node or an edge is one value of several lines."""
    nodes = numbered(tiers, ["page_id", "ts"])
    node = F.concat(
        F.lit('<node id="n'), F.col("number"), F.lit('">\n<data key="d0">'), xml_escape(F.col("title")), F.lit('</data>\n<data key="d1">'), F.col("ns_id"),
        F.lit('</data>\n<data key="d2">'), F.col("page_id"), F.lit('</data>\n<data key="d3">'), xml_escape(zoned_instant(F.col("ts"))), F.lit("</data>\n</node>"),
    )
    edge = F.concat(
        F.lit('<edge id="e'), F.col("edge"), F.lit('" source="n'), F.col("source"), F.lit('" target="n'), F.col("target"), F.lit('">\n<data key="d4">'), xml_escape(F.col("link_type")), F.lit("</data>\n</edge>")
    )
    return _joined(_lines(tiers, *GRAPHML_HEAD), nodes.select(node.alias("value")), tier_edges(links, nodes, types).select(edge.alias("value")), _lines(tiers, "</graphml>"))


def _graph_text(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices: ``vertex, title, ns_id, ts``; edges: ``a, b, link_type``."""
    shown = lambda name, value: F.concat(F.lit(f"[{name}¤"), value, F.lit("¤]¤"))
    title = graph_escape(F.coalesce("title", F.lit("")))
    vertex = F.concat(F.col("vertex"), F.lit("¤"), shown("Title", title), shown("NSID", F.col("ns_id").cast("string")), shown("Timestamp", graph_escape(zoned_instant(F.col("ts")))))
    edge = F.concat(F.col("a"), F.lit("¤"), F.col("b"), F.lit("¤1.0¤"), shown("Type", graph_escape(F.col("link_type"))))
    return _joined(_lines(vertices, *GRAPH_TEXT_HEAD), vertices.select(vertex.alias("value")), _lines(vertices, "Edges:"), edges.select(edge.alias("value")))


def _node(number: str):
    return F.concat(F.lit("n"), F.col(number))


def tier_graph_text(tiers: DataFrame, links: DataFrame, types=()) -> DataFrame:
    """SNK2: tiers have ``page_id, ts, ns_id, title``; vertices are numbered by page and instant."""
    nodes = numbered(tiers, ["page_id", "ts"])
    edges = tier_edges(links, nodes, types).select(_node("source").alias("a"), _node("target").alias("b"), "link_type")
    return _graph_text(nodes.select(_node("number").alias("vertex"), "title", "ns_id", "ts"), edges)


def page_graph_text(pages: DataFrame, links: DataFrame, types=(), layer=SENTINEL_LAYER) -> DataFrame:
    """SNK3: pages (``page_id, ns_id, title``) and their links in the layer of the present, as tiers of that instant."""
    ts = F.lit(layer).cast(links.schema["ts"].dataType).alias("ts")
    return tier_graph_text(pages.select("page_id", ts, "ns_id", "title"), at_layer(links, layer), types)


def current_graph_text(pages: DataFrame, revisions: DataFrame, links: DataFrame, namespaces=()) -> DataFrame:
    """SNK4: pages (``page_id, ns_id, title``) with their latest revision, present links of all types; no namespaces mean all."""
    chosen = pages.where(F.col("ns_id").isin(*namespaces)) if namespaces else pages
    last = latest_revision(revisions.select("page_id", "revision_id", "ts"))
    named = chosen.join(last, "page_id").withColumn("vertex", F.concat_ws("_", "page_id", "revision_id"))
    a, b = (named.select(F.col("page_id").alias(f"{end}_id"), F.col("vertex").alias(c)) for end, c in (("source", "a"), ("target", "b")))
    edges = at_layer(links).join(a, "source_id").join(b, "target_id").select("a", "b", "link_type")
    return _graph_text(named.select("vertex", "title", "ns_id", "ts"), edges)


def tei_documents(rows: DataFrame, ids: list[str], flat: bool = False) -> DataFrame:
    """SNK6: ``value``: one TEI document per row with ``html, namespace, title``; the columns ``ids`` become idno elements."""
    named = F.map_concat(*[F.create_map(F.lit(c), F.col(c).cast("string")) for c in ids]) if ids else F.create_map().cast("map<string,string>")
    return rows.select(tei(F.col("html"), qualified_title(F.col("namespace"), F.col("title")), named, flat).alias("value")).where(F.col("value").isNotNull())


def tei_corpus(rows: DataFrame, ids: list[str], flat: bool = False) -> DataFrame:
    """SNK5."""
    return _joined(_lines(rows, '<?xml version="1.0" encoding="utf-8"?>', "<teiCorpus>"), tei_documents(rows, ids, flat), _lines(rows, "</teiCorpus>"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
