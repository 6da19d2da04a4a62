"""Pages rendered as of an instant (HTML4, TT12, GR3 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.markup import MAX_DEPTH, rendered
from palimpsest.functions.text import first_upper, spaced
from palimpsest.operators.history import first_revision, instant, revision_at
from palimpsest.operators.links import extract_links, of_types
from palimpsest.storage import materialise

#: Fixed value: the namespace of templates.
TEMPLATE_NS = 10
NAME = r"\{\{\s*([^{}|#]+?)\s*[|}]"


def template_titles(text: Column) -> Column:
    """Titles of the templates that a text names."""
    names = F.regexp_extract_all(text, F.lit(NAME), F.lit(1))
    plain = F.transform(names, lambda n: F.trim(F.regexp_replace(F.regexp_replace(spaced(n), r"\s+", " "), r"(?i)^template:\s*", "")))
    return F.array_distinct(F.transform(plain, first_upper))


def templates_at(pages: DataFrame, revisions: DataFrame, at) -> DataFrame:
    """HTML4: ``title, body`` of all templates at an instant; of those that begin later, the first text."""
    own = revisions.join(pages.where(F.col("ns_id") == TEMPLATE_NS).select("page_id", "title"), "page_id")
    rows = own.select("page_id", "revision_id", "ts", "title", "text")
    then, first = revision_at(rows, at).select("title", F.col("text").alias("then")), first_revision(rows).select("title", F.col("text").alias("first"))
    return first.join(then, "title", "left").select("title", F.coalesce("then", "first").alias("body"))


def with_templates(texts: DataFrame, templates: DataFrame, levels: int = MAX_DEPTH) -> DataFrame:
    """``texts`` (``page_id, text`` and more) with ``templates``: a map of all templates that a page needs.

    Only names are exploded; each level joins the names that the last one brought up and that are new to the page, until
    there are none, or as deep as texts are transcluded.
    """
    bodies = templates.dropDuplicates(["title"]).select("title", "body", template_titles(F.col("body")).alias("_inner"))
    wanted = texts.select("page_id", F.explode(template_titles(F.col("text"))).alias("title")).distinct()
    found = None
    for _ in range(levels):
        level = materialise(wanted.join(bodies, "title"), "templates")
        found = level if found is None else found.unionByName(level)
        wanted = level.select("page_id", F.explode("_inner").alias("title")).distinct().join(found.select("page_id", "title"), ["page_id", "title"], "left_anti")
        if level.isEmpty():
            break
    maps = found.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("title", "body"))).alias("templates"))
    return texts.join(maps, "page_id", "left")


def render_snapshot(pages: DataFrame, revisions: DataFrame, at, category_names=("Category",)) -> DataFrame:
    """TT12: ``page_id, ts, html`` of every page that exists at an instant, with the templates of that instant."""
    then = revision_at(revisions.select("page_id", "revision_id", "ts", "text"), at).select("page_id", "text")
    texts = with_templates(then, templates_at(pages, revisions, at))
    titled = texts.join(pages.select("page_id", "title"), "page_id")
    return titled.select("page_id", instant(revisions, at).alias("ts"), rendered(F.col("title"), F.col("text"), F.col("templates"), category_names).alias("html"))


def revision_links(pages: DataFrame, revisions: DataFrame, namespaces: DataFrame, at, types=(), category_names=("Category",)) -> DataFrame:
    """GR3: the links out of single revisions (``db_name, page_id, revision_id, ts, text``), rendered with the templates of ``at``.

    ``source_id`` is the revision's page; each target must have existed at the revision's own time. No types mean all.
    """
    wanted = revisions.withColumnRenamed("page_id", "_page").withColumnRenamed("revision_id", "page_id")
    texts = with_templates(wanted, templates_at(pages, revisions, at)).withColumnRenamed("page_id", "revision_id").withColumnRenamed("_page", "page_id")
    titled = texts.join(pages.select("db_name", "page_id", "title"), ["db_name", "page_id"])
    html = titled.select("db_name", "revision_id", "page_id", "ts", rendered(F.col("title"), F.col("text"), F.col("templates"), category_names).alias("html"))
    owned = html.select("db_name", F.col("revision_id").alias("page_id"), "ts", "html")
    found = of_types(extract_links(owned, pages, namespaces, revisions), types).withColumnRenamed("source_id", "revision_id")
    return found.join(revisions.select("db_name", "revision_id", F.col("page_id").alias("source_id")), ["db_name", "revision_id"]).select("db_name", "revision_id", "source_id", "target_id", "link_type", "ts")
