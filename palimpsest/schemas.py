"""Tables of the wiki model.

Every table has ``db_name``, so that many wikis share one set of tables; links
and tiers carry the instant (``ts``) they hold for.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: The layer of links that come from SQL dumps, which describe the present.
SENTINEL_LAYER = "3000-01-01 00:00:00"
KEY_FRAME_INTERVAL = 50

# Names that the dumps and tables use.
ARTICLE, REDIRECT, CATEGORIZATION = "ARTICLE", "REDIRECT", "CATEGORIZATION"
LINK_TYPES = (ARTICLE, REDIRECT, CATEGORIZATION)
CATEGORY_NS = 14
CODECS = ("NONE", "GZIP", "BZIP2", "LZMA2", "DIFFBZIP2")


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_string, _long, _int, _time = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()

WIKI = _struct(db_name=_string, site_name=_string, base=_string, generator=_string, api_url=_string, case=_string)
NAMESPACE = _struct(db_name=_string, ns_id=_int, case=_string, name=_string, canonical_name=_string, aliases=T.ArrayType(_string), all_names=T.ArrayType(_string))
PAGE = _struct(db_name=_string, page_id=_long, ns_id=_int, title=_string)
REVISION = _struct(
    db_name=_string, revision_id=_long, page_id=_long, parent_id=_long, ts=_time, tz=_string, contributor_id=_long, ip=_string,
    comment=_string, minor=T.BooleanType(), sha1=_string, model=_string, format=_string, bytes=_int, text=_string,
)
CONTRIBUTOR = _struct(db_name=_string, contributor_id=_long, name=_string)
TIER = _struct(db_name=_string, page_id=_long, ts=_time, tz=_string, html=_string)
LINK = _struct(db_name=_string, source_id=_long, target_id=_long, link_type=_string, ts=_time)
ENTITY_USAGE = _struct(db_name=_string, page_id=_long, entity_id=_string, aspect=_string)

TABLES = {
    "wiki": WIKI, "namespace": NAMESPACE, "page": PAGE, "revision": REVISION, "contributor": CONTRIBUTOR,
    "page_tier": TIER, "link": LINK, "entity_usage": ENTITY_USAGE,
}
#: Rows with equal keys are one; a table without a key may hold equal rows.
KEYS = {
    "wiki": ["db_name"], "namespace": ["db_name", "name"], "page": ["db_name", "page_id"], "revision": ["db_name", "revision_id"],
    "contributor": ["db_name", "contributor_id"], "page_tier": ["db_name", "page_id", "ts"],
    "link": ["db_name", "source_id", "target_id", "link_type", "ts"], "entity_usage": None,
}
#: What the files of a table are split and sorted by; but for revisions it is part of the key.
CLUSTERS = {
    "wiki": ["db_name"], "namespace": ["name"], "page": ["page_id"], "revision": ["page_id"], "contributor": ["contributor_id"],
    "page_tier": ["page_id"], "link": ["source_id"], "entity_usage": ["page_id"],
}
LAYERED = ("page_tier", "link")
