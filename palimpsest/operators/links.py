"""Links from rendered pages, and link layers (HTML1, JN7, JN11-12, GR1-5, SET1, AG3-6, FLT13).

Extraction is all Catalyst: the anchors of a page are an array, exploded once, and
targets are resolved by equi-joins with the namespace names and the pages. A name that very many links have is not a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import first_upper, spaced
from palimpsest.schemas import ARTICLE, CATEGORIZATION, CATEGORY_NS, REDIRECT, SENTINEL_LAYER
from palimpsest.storage import materialise

# What counts as a comment and as an anchor decides which links there are.
COMMENT = "<!--.*?-->"
ANCHOR = '<a[ ][^>]*?href="([^">]+)'
CATEGORY_BOX = 'id="catlinks"'
#: Links to one name from which they are not shuffled, and names that may be sent to all executors for that.
HEAVY_NAME, BROADCAST_NAMES = 100_000, 10_000
LINK_KEY = ["source_id", "target_id", "link_type", "ts"]


def uncommented(html: Column) -> Column:
    """Comments that end on the line they begin on go; others stay."""
    return F.regexp_replace(html, COMMENT, "")


def is_redirect(clean: Column) -> Column:
    """HTML2: a redirect notice right behind the first heading, or a redirect class anywhere."""
    rest = F.substr(clean, F.locate("</h1>", clean) + 5)
    notice = F.upper(F.regexp_replace(F.regexp_replace(rest, "<.*?>", ""), r"^[\x00-\x20]+", "")).startswith("REDIRECT")
    named = clean.contains('class="redirectText"') | clean.contains('class="redirectMsg"')
    return (F.upper(clean).contains("REDIRECT") & notice) | named


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """HTML1, steps 1-4a: one row per anchor: all columns but the html, ``k`` (from 1), ``href``, ``redirect``, ``in_category_box``.

    An anchor is in the category box if it starts behind the box's id, that is if more
    anchors come before it than before the id.
    """
    keep = [c for c in pages.columns if c != html]
    clean = pages.withColumn("_clean", uncommented(F.col(html)))
    box = F.locate(CATEGORY_BOX, F.col("_clean"))
    before = F.when(box > 0, F.size(F.regexp_extract_all(F.substr("_clean", F.lit(1), box - 1), F.lit(ANCHOR), F.lit(1))))
    found = clean.select(
        *keep, is_redirect(F.col("_clean")).alias("redirect"), before.alias("_before"), F.posexplode(F.regexp_extract_all("_clean", F.lit(ANCHOR), F.lit(1))).alias("_i", "href")
    )
    return found.select(*keep, (F.col("_i") + 1).alias("k"), "href", "redirect", (F.col("_i") >= F.coalesce("_before", F.lit(1 << 30))).alias("in_category_box"))


def local_target(href: Column, prefix: str = "/wiki/") -> Column:
    """HTML1, step 4: the target's text of a local link, else null; malformed escapes leave the link as it is."""
    path = F.substring_index(href, "#", 1)
    decoded = F.try_url_decode(spaced(F.substr(path, F.lit(len(prefix) + 1))))
    return F.when(path.startswith(prefix) & (F.length(path) > len(prefix)), F.coalesce(decoded, path))


def split_namespace(targets: DataFrame, namespaces: DataFrame, text: str = "target", key=()) -> DataFrame:
    """FLT6, step 5: ``target_ns``, ``target_title``; a prefix that no namespace has leaves the text in namespace 0."""
    names = namespaces.select(*key, F.col("ns_id").alias("_ns"), F.col("case").alias("_case"), F.explode("all_names").alias("_name")).dropDuplicates([*key, "_name"])
    main = names.where(F.col("_ns") == 0).groupBy(*key).agg(F.first("_case").alias("_main")) if key else names.where(F.col("_ns") == 0).agg(F.first("_case").alias("_main"))
    at = F.locate(":", F.col(text))
    prefixed = targets.withColumn("_name", F.when(at > 0, F.substr(F.col(text), F.lit(1), at - 1)))
    joined = prefixed.join(F.broadcast(names), [*key, "_name"], "left")
    joined = joined.join(F.broadcast(main), list(key), "left") if key else joined.join(F.broadcast(main), F.lit(True), "left")  # one row
    known = F.col("_ns").isNotNull() & (F.col("_ns") != 0)
    title = F.when(known, F.substr(F.col(text), at + 1)).otherwise(F.col(text))
    case = F.when(known, F.col("_case")).otherwise(F.col("_main"))
    titled = joined.withColumn("target_ns", F.when(known, F.col("_ns")).otherwise(F.lit(0))).withColumn("_title", title)
    return titled.withColumn("target_title", F.when(case == "FIRST_LETTER", first_upper(F.col("_title"))).otherwise(F.col("_title"))).drop("_name", "_ns", "_case", "_main", "_title")


def extract_links(tiers: DataFrame, pages: DataFrame, namespaces: DataFrame, revisions: DataFrame | None = None, prefix: str = "/wiki/", key=("db_name",)) -> DataFrame:
    """HTML1/GR3/GR5: ``key, source_id, target_id, link_type, ts`` of rendered pages (``key, page_id, ts, html``).

    With ``revisions``, a target must have one at ``ts`` or before. The first anchor of a
    redirect is both REDIRECT and ARTICLE; categories in the category box are
    CATEGORIZATION; all else is ARTICLE.
    """
    key = list(key)
    found = anchors(tiers.select(*key, F.col("page_id").alias("source_id"), "ts", "html")).withColumn("target", local_target(F.col("href"), prefix)).where(F.col("target").isNotNull())
    named = split_namespace(found, namespaces, key=key)
    # Of pages whose titles collide, the smallest page_id counts.
    targets = pages.groupBy(*key, F.col("ns_id").alias("target_ns"), F.col("title").alias("target_title")).agg(F.min("page_id").alias("target_id"))
    if revisions is not None:
        targets = targets.join(_born(revisions, key), [*key, "target_id"])
    resolved = _resolved(materialise(named.select(*key, "source_id", "ts", "k", "redirect", "in_category_box", "target_ns", "target_title"), "anchors"), targets, [*key, "target_ns", "target_title"])
    if revisions is not None:
        resolved = resolved.where(F.col("_born") <= F.col("ts"))
    first = F.col("redirect") & (F.col("k") == 1)
    boxed = (F.col("target_ns") == CATEGORY_NS) & F.col("in_category_box")
    types = F.when(first, F.array(F.lit(REDIRECT), F.lit(ARTICLE))).when(boxed, F.array(F.lit(CATEGORIZATION))).otherwise(F.array(F.lit(ARTICLE)))
    return resolved.select(*key, "source_id", "target_id", F.explode(types).alias("link_type"), "ts").distinct()


def _resolved(named: DataFrame, targets: DataFrame, on: list[str], heavy: int | None = None) -> DataFrame:
    """``named``, which is written, with the columns of ``targets``, joined by name.

    Names are counted first and met with the targets once each. Those with more than ``HEAVY_NAME`` links, of which there
    can be only a fraction of the links, are sent to all executors if they are few, so their links stay where they are; others are shuffled.
    """
    counted = materialise(named.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).join(targets, on), "names")
    hot = counted.where(F.col("_n") > (HEAVY_NAME if heavy is None else heavy)).drop("_n")
    n = hot.count()
    if not 0 < n <= BROADCAST_NAMES:
        return named.join(counted.drop("_n"), on)
    rest = named.join(F.broadcast(hot.select(*on)), on, "left_anti").join(counted.drop("_n"), on)
    return named.join(F.broadcast(hot), on).unionByName(rest)


def _born(revisions: DataFrame, key) -> DataFrame:
    return revisions.groupBy(*key, F.col("page_id").alias("target_id")).agg(F.min("ts").alias("_born"))


def targets_existing(links: DataFrame, revisions: DataFrame, key=()) -> DataFrame:
    """JN12: links whose target had its first revision at ``ts`` or before."""
    return links.join(_born(revisions, key), [*key, "target_id"]).where(F.col("_born") <= F.col("ts")).select(links.columns)


def distinct_links(links: DataFrame, key=()) -> DataFrame:
    """SET1."""
    return links.dropDuplicates([*key, *LINK_KEY])


def add_links(links: DataFrame, new: DataFrame, key=()) -> DataFrame:
    """GR4: both layers' links, each once."""
    return distinct_links(links.unionByName(new), key)


def of_types(links: DataFrame, types=()) -> DataFrame:
    """FLT13: no types means all."""
    return links.where(F.col("link_type").isin(*types)) if types else links


def at_layer(links: DataFrame, layer=SENTINEL_LAYER, types=()) -> DataFrame:
    """Links of one layer; the layer's instant must be equal, not just before."""
    return of_types(links, types).where(F.col("ts") == F.lit(layer).cast(links.schema["ts"].dataType))


def links_out(links: DataFrame, pages: DataFrame, layer=SENTINEL_LAYER, types=(), key=()) -> DataFrame:
    """GR1: links from the given pages."""
    return at_layer(links, layer, types).join(pages.select(*key, F.col("page_id").alias("source_id")).distinct(), [*key, "source_id"], "left_semi")


def links_in(links: DataFrame, pages: DataFrame, layer=SENTINEL_LAYER, types=(), key=()) -> DataFrame:
    """GR1: links to the given pages."""
    return at_layer(links, layer, types).join(pages.select(*key, F.col("page_id").alias("target_id")).distinct(), [*key, "target_id"], "left_semi")


def tier_links(links: DataFrame, tiers: DataFrame, outgoing: bool = True, key=()) -> DataFrame:
    """GR2: links of each tier's page at the tier's own instant."""
    end = "source_id" if outgoing else "target_id"
    return links.join(tiers.select(*key, F.col("page_id").alias(end), "ts").distinct(), [*key, end, "ts"], "left_semi")


def targets_by_type(links: DataFrame, key=()) -> DataFrame:
    """AG3: sorted set of targets of each page and type."""
    return links.groupBy(*key, "source_id", "link_type").agg(F.array_sort(F.collect_set("target_id")).alias("targets"))


def layers_of_edges(links: DataFrame, key=()) -> DataFrame:
    """AG4: sorted set of layers of each edge."""
    return links.groupBy(*key, "source_id", "target_id", "link_type").agg(F.array_sort(F.collect_set("ts")).alias("layers"))


def layers(links: DataFrame, key=()) -> DataFrame:
    """AG5/AG6: which layers there are of which types."""
    return links.select(*key, "link_type", "ts").distinct()


def entities_by_aspect(usage: DataFrame, key=()) -> DataFrame:
    """JN8: sorted list of a page's entities for each aspect, repeats included."""
    return usage.groupBy(*key, "page_id", "aspect").agg(F.array_sort(F.collect_list("entity_id")).alias("entities"))
