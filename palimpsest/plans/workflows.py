"""Whole tasks on a catalog: tiers at an instant, the network then, its evaluation and export (TT12, GR5, GR8, AG7, SNK2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.evaluation import link_evaluation
from palimpsest.operators.history import new_tiers
from palimpsest.operators.links import extract_links
from palimpsest.operators.lookups import in_namespaces
from palimpsest.operators.rendering import render_snapshot
from palimpsest.schemas import CATEGORY_NS, LINK_TYPES, SENTINEL_LAYER
from palimpsest.sources.catalog import Catalog
from palimpsest.sources.exports import tier_graph_text, write_lines


def _of(catalog: Catalog, name: str, db_name: str) -> DataFrame:
    return catalog.read(name).where(F.col("db_name") == db_name)


def create_tiers(catalog: Catalog, db_name: str, at: str, namespaces=()) -> None:
    """Render every page that exists at an instant and has no tier there yet; templates come from all pages."""
    pages, revisions = _of(catalog, "page", db_name), _of(catalog, "revision", db_name)
    names = _of(catalog, "namespace", db_name).where(F.col("ns_id") == CATEGORY_NS).select("all_names").first()
    wanted = new_tiers(_of(catalog, "page_tier", db_name), in_namespaces(pages, namespaces), at)
    html = render_snapshot(pages, revisions, at, tuple(names["all_names"]) if names else ("Category",)).join(wanted, ["page_id", "ts"], "left_semi")
    catalog.add("page_tier", html.select(F.lit(db_name).alias("db_name"), "page_id", "ts", F.lit("UTC").alias("tz"), "html"))


def extract_network(catalog: Catalog, db_name: str, at: str) -> None:
    """Add the links of all tiers at an instant, as that instant's layer."""
    tiers = _of(catalog, "page_tier", db_name).where(F.col("ts") == F.lit(at).cast("timestamp"))
    found = extract_links(tiers, _of(catalog, "page", db_name), _of(catalog, "namespace", db_name), _of(catalog, "revision", db_name))
    catalog.add("link", found)


def evaluate_network(catalog: Catalog, db_name: str, at: str, gold_layer: str = SENTINEL_LAYER) -> DataFrame:
    """How well the layer of an instant agrees with the one from SQL dumps."""
    edges = _of(catalog, "link", db_name).select(F.col("source_id").alias("page_id"), "link_type", "target_id", "ts")
    layer = lambda t: edges.where(F.col("ts") == F.lit(t).cast("timestamp")).drop("ts")
    return link_evaluation(_of(catalog, "page", db_name), layer(gold_layer), layer(at))


def export_network(catalog: Catalog, db_name: str, at: str, path: str, types=LINK_TYPES) -> None:
    """Write the graph text of the pages and links at an instant."""
    then = _of(catalog, "page_tier", db_name).where(F.col("ts") == F.lit(at).cast("timestamp")).select("page_id", "ts")
    tiers = then.join(_of(catalog, "page", db_name), "page_id").select("page_id", "ts", "ns_id", "title")
    write_lines(tier_graph_text(tiers, _of(catalog, "link", db_name), types), path)
