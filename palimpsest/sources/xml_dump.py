"""MediaWiki XML dumps as tables (SRC1-8, SRC16 of the survey).

A dump is read as text that is cut behind every ``</revision>``, so a row is one revision, however long the
history of its page, and Spark splits plain and bzip2 files wherever it likes; gzip files are read whole by one task each. A 7z archive
has to be unpacked first. The head of a page (title, namespace, id) stands before its first revision only. Each task
carries the last head on to the revisions behind it; those at the beginning of a split get the last head of
the splits before it in their file, of which there is one a split. Everything after that is projections
and removal of repeats by key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import CASES, FORMATS, MODELS, decoded, normal_title, without_prefix
from palimpsest.storage import by_shuffle, materialise

_text = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_bytes", T.IntegerType())])
_contributor = T.StructType([T.StructField("username", T.StringType()), T.StructField("id", T.LongType()), T.StructField("ip", T.StringType())])
_revision = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("parentid", T.LongType()), T.StructField("timestamp", T.StringType()), T.StructField("contributor", _contributor),
        T.StructField("minor", T.StringType()), T.StructField("comment", T.StringType()), T.StructField("model", T.StringType()), T.StructField("format", T.StringType()),
        T.StructField("text", _text), T.StructField("sha1", T.StringType()),
    ]
)
PAGE_HEAD = T.StructType([T.StructField("title", T.StringType()), T.StructField("ns", T.IntegerType()), T.StructField("id", T.LongType())])
_namespace = T.StructType([T.StructField("_key", T.IntegerType()), T.StructField("_case", T.StringType()), T.StructField("_VALUE", T.StringType())])
SITE_ELEMENT = T.StructType(
    [
        *[T.StructField(x, T.StringType()) for x in ("sitename", "dbname", "base", "generator", "case")],
        T.StructField("namespaces", T.StructType([T.StructField("namespace", T.ArrayType(_namespace))])),
    ]
)


def _read(spark: SparkSession, path: str | list[str], tag: str, schema: T.StructType) -> DataFrame:
    # White space in texts counts, so it isn't trimmed.
    return spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", "false").schema(schema).load(path)


REVISION_END = "</revision>"
#: The head of a page: what stands between its tag and its first revision or its end.
HEAD = re.compile(r"<page>(.*?)(?=<revision>|</page>|\Z)", re.DOTALL)
#: A revision as exports write it. Any other is parsed by Spark, which takes twenty times as long.
USUAL = re.compile(
    r"\s*<id>(\d{1,18})</id>\s*(?:<parentid>(\d{1,18})</parentid>\s*)?<timestamp>([^<>&]+)</timestamp>\s*<contributor>\s*(?:<username>([^<>&]+)</username>\s*<id>(\d{1,18})</id>|<ip>([^<>&]+)</ip>)\s*</contributor>\s*"
    r"(<minor ?/>\s*)?(?:<comment>([^<>&]*)</comment>\s*)?(?:<model>([^<>&]+)</model>\s*)?(?:<format>([^<>&]+)</format>\s*)?<text(?: xml:space=\"preserve\"| bytes=\"(\d{1,9})\"){0,2}>([^<>]*)</text>\s*(?:<sha1>([^<>&]+)</sha1>\s*)?\Z",
    re.ASCII,
)
#: What ``USUAL`` finds, by column.
FOUND = {"r_id": pa.int64(), "r_parentid": pa.int64(), "r_timestamp": pa.string(), "r_username": pa.string(), "r_userid": pa.int64(), "r_ip": pa.string(), "r_minor": pa.string(), "r_comment": pa.string(), "r_model": pa.string(), "r_format": pa.string(), "r_bytes": pa.int32(), "r_text": pa.string(), "r_sha1": pa.string()}
_CHARACTERS = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}  # the ampersand last
_LOCATED = "file string, split long, place long, heads array<string>, head string, value string, " + ", ".join(f"{c} {'string' if t == pa.string() else 'long' if t == pa.int64() else 'int'}" for c, t in FOUND.items())


def _usual(value: str) -> tuple | None:
    """What ``FOUND`` names of a revision; none if it isn't as usual."""
    found = USUAL.match(value, value.find("<revision>") + len("<revision>")) if "<revision>" in value and "\r" not in value else None
    if found is None or any(x and x.isspace() for x in found.groups()):  # the parser has a way with these
        return None
    number, parent, *rest, size, text, sha1 = found.groups()
    if "&" in text:
        if text.count("&") != sum(map(text.count, _CHARACTERS)):
            return None
        for entity, character in _CHARACTERS.items():
            text = text.replace(entity, character)
    rest[2] = rest[2] and int(rest[2])
    return int(number), parent and int(parent), *rest, size and int(size), text, sha1


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", REVISION_END).text(path)


def _records(spark: SparkSession, path: str | list[str], heads_only: bool = False) -> DataFrame:
    """``file, split, place, heads, head, value``: pieces of the dump up to each end of a revision, in order of ``place`` within their split.

    ``heads`` are those of the pages that begin in the piece; ``head`` is that of the page of its revision, null where it stands in an earlier split.
    A revision that is as usual is in the columns of ``FOUND``, and ``value`` is then null. ``heads_only`` leaves out pieces in which no page begins.
    """
    lines = _pieces(spark, path)
    lines = lines.where(F.col("value").contains("<page>")) if heads_only else lines
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    nothing = (None,) * len(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place, head = None, 0, None
        for batch in batches:
            places, heads, own, values, rows = [], [], [], [], []
            files = batch["file"].dictionary_encode()
            names = files.dictionary.to_pylist()
            for number, split, text in zip(files.indices.to_pylist(), batch["split"].to_pylist(), batch["value"].to_pylist(), strict=True):
                if at is None or split != at[1] or names[number] != at[0]:
                    at, place, head = (names[number], split), 0, None
                found = HEAD.findall(text) if "<page>" in text else []
                head = found[-1] if found else head
                usual = None if heads_only else _usual(text)
                places.append(place)
                heads.append(found)
                own.append(head)
                values.append(None if usual else text)
                rows.append(usual or nothing)
                place += 1
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), FOUND.values(), strict=True)] if rows else [pa.array([], t) for t in FOUND.values()]
            yield pa.RecordBatch.from_arrays(
                [batch["file"], batch["split"], pa.array(places, pa.int64()), pa.array(heads, pa.list_(pa.string())), pa.array(own, pa.string()), pa.array(values, pa.string()), *columns],
                names=["file", "split", "place", "heads", "head", "value", *FOUND],
            )

    return placed.mapInArrow(run, _LOCATED)


def _site(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The heads of the dump's files, one row a file."""
    inside = F.regexp_extract("value", r"(?s)<siteinfo(?:\s[^>]*)?>(.*?)</siteinfo>", 1)
    found = _pieces(spark, path).where(F.col("value").contains("</siteinfo>")).select(_element("siteinfo", inside, SITE_ELEMENT).alias("s")).select("s.*")
    return materialise(found, "site")


def _tails(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, split, _tail``: the last head in each split, one row a split; null where no page begins."""
    head = F.when(F.col("value").contains("<page>"), F.regexp_extract("value", r"(?s).*<page>(.*?)(?:<revision>|</page>|\z)", 1))
    rows = _pieces(spark, path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), head.alias("head"), F.monotonically_increasing_id().alias("place"))
    return rows.groupBy("file", "split").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("place"))).alias("_tail"))


def _headed(records: DataFrame, tails: DataFrame) -> DataFrame:
    """``records`` with the heads that their splits inherit: of a file's splits, in order, the last that has one."""
    inherited = tails.select("file", "split", F.last("_tail", ignorenulls=True).over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)).alias("_inherited")).where("_inherited IS NOT NULL")
    return records.join(F.broadcast(inherited), ["file", "split"], "left").withColumn("head", F.coalesce("head", "_inherited")).drop("_inherited").where("head IS NOT NULL")  # one row a split


def _element(name: str, inside: Column, schema: T.StructType) -> Column:
    return F.from_xml(F.concat(F.lit(f"<{name}>"), inside, F.lit(f"</{name}>")), schema.simpleString(), {"ignoreSurroundingSpaces": "false", "rowTag": name})


#: The head of a page as exports write it.
USUAL_HEAD = r"^\s*<title>([^<>&\r]*[^<>&\s][^<>&\r]*)</title>\s*<ns>(-?[0-9]{1,9})</ns>\s*<id>([0-9]{1,18})</id>\s*(?:<redirect title=\"[^\"<>&]*\" ?/>\s*)?$"


def _page_of(head: Column) -> Column:
    """``title, ns, id`` of a page's head."""
    part = lambda i: F.regexp_extract(head, USUAL_HEAD, i)
    usual = F.struct(part(1).alias("title"), part(2).cast("int").alias("ns"), part(3).cast("long").alias("id"))
    return F.when(head.rlike(USUAL_HEAD), usual).otherwise(_element("page", head, PAGE_HEAD))


def _pages(records: DataFrame) -> DataFrame:
    """``id, ns, title`` of every ``<page>``, those without revisions included."""
    return records.select(F.explode("heads").alias("head")).select(_page_of(F.col("head")).alias("p")).select("p.*")


def _revisions(records: DataFrame, tails: DataFrame) -> DataFrame:
    """``id, ns, title`` of the page and ``value``, the text of the element, of every revision; the columns of ``FOUND`` where ``value`` is null."""
    complete = _headed(records.where(F.col("r_id").isNotNull() | F.col("value").contains("<revision>")), tails)
    value = F.substr("value", F.locate("<revision>", F.col("value")) + len("<revision>")).alias("value")
    return complete.select(_page_of(F.col("head")).alias("p"), value, *FOUND).select("p.*", "value", *FOUND)


def _revision_of() -> Column:
    """The parsed element."""
    c = lambda name: F.col(f"r_{name}")
    usual = F.struct(
        c("id").alias("id"), c("parentid").alias("parentid"), c("timestamp").alias("timestamp"), F.struct(c("username").alias("username"), c("userid").alias("id"), c("ip").alias("ip")).alias("contributor"),
        c("minor").alias("minor"), c("comment").alias("comment"), c("model").alias("model"), c("format").alias("format"), F.struct(c("text").alias("_VALUE"), c("bytes").alias("_bytes")).alias("text"), c("sha1").alias("sha1"),
    )
    return F.when(F.col("r_id").isNotNull(), usual).otherwise(_element("revision", F.col("value"), _revision))


def files_by_wiki(spark: SparkSession, paths: list[str]) -> dict[str | None, list[str]]:
    """The dump files of each wiki, by what their heads say; one row a file comes to the driver."""
    heads = _read(spark, paths, "siteinfo", SITE_ELEMENT).select(F.col("_metadata.file_path").alias("file"), F.col("dbname")) if paths else None
    found: dict[str | None, list[str]] = {}
    for r in heads.distinct().collect() if heads is not None else []:
        found.setdefault(r["dbname"], []).append(r["file"])
    return found


def in_namespaces(ids=()) -> Column:
    """SRC7: an import filter; no ids accepts all."""
    return F.col("ns").isin(*ids) if ids else F.lit(True)


def read_dump(spark: SparkSession, path: str | list[str], accept: Column | None = None, aliases: dict[int, list[str]] | None = None, staged: bool = False) -> Mapping[str, DataFrame]:
    """The tables ``wiki, namespace, page, revision, contributor`` of one wiki's dump files.

    ``accept`` is a condition on ``id, ns, title`` that is tested before revisions are parsed (SRC6).
    A page may be continued in a later element; repeated revisions count once, as does
    a contributor, by the name of its first revision. ``aliases`` are further namespace
    names by id, which dumps lack. ``staged`` parses the dump once into Parquet in the shared
    folder, from which the tables then read; otherwise each table that is used scans the XML,
    and ``revision`` counts the ids of revisions when it is asked for.
    """
    site, records = _site(spark, path), _records(spark, path)
    if staged:
        records = materialise(records, "dump")
    pages, held = _pages(records if staged else _records(spark, path, heads_only=True)), _revisions(records, _tails(spark, path))
    if accept is not None:
        pages, held = pages.where(accept), held.where(accept)
    wiki = site.select(
        F.col("dbname").alias("db_name"), F.col("sitename").alias("site_name"), "base", "generator",
        F.when(F.col("base").contains("/wiki/"), F.concat(F.substring_index("base", "/wiki/", 1), F.lit("/w/api.php")))
        .otherwise(F.raise_error(F.concat(F.lit("no /wiki/ in the base address: "), F.coalesce("base", F.lit("none")))).cast("string")).alias("api_url"),
        decoded(CASES, F.col("case"), None, None).alias("case"),
    ).dropDuplicates(["db_name"])
    namespace = _namespaces(spark, site, aliases or {})

    if wiki.limit(2).count() > 1:
        raise ValueError("the files are dumps of more than one wiki; read each wiki's on its own")
    db = F.broadcast(wiki.select("db_name"))  # one row
    own = namespace.select("db_name", "ns_id", F.col("case").alias("_case")).dropDuplicates(["db_name", "ns_id"])
    titled = pages.select(F.col("id").alias("page_id"), F.col("ns").alias("ns_id"), without_prefix(F.col("title"), F.col("ns")).alias("title"))
    page = (
        titled.groupBy("page_id").agg(F.first("ns_id").alias("ns_id"), F.min("title").alias("title"))
        .join(db, F.lit(True)).join(F.broadcast(own), ["db_name", "ns_id"], "left")
        .select("db_name", "page_id", "ns_id", normal_title(F.col("title"), F.col("_case")).alias("title"))
    )

    rows = held.select(F.col("id").alias("page_id"), _revision_of().alias("r")).where("r.id IS NOT NULL")  # a file may be cut off
    author = F.col("r.contributor")
    revision = rows.select(
        F.col("r.id").alias("revision_id"), "page_id", F.nullif(F.col("r.parentid"), F.lit(-1)).alias("parent_id"),
        F.to_timestamp("r.timestamp").alias("ts"), F.lit("UTC").alias("tz"), author["id"].alias("contributor_id"), author["ip"].alias("ip"),
        F.nullif(F.col("r.comment"), F.lit("")).alias("comment"), F.col("r.minor").isNotNull().alias("minor"), F.col("r.sha1").alias("sha1"),
        decoded(MODELS, F.col("r.model"), "WIKITEXT", "UNKNOWN").alias("model"), decoded(FORMATS, F.col("r.format"), "TEXT_XWIKI", None).alias("format"),
        F.coalesce(F.nullif(F.col("r.text._bytes"), F.lit(0)), F.octet_length(F.coalesce("r.text._VALUE", F.lit("")))).alias("bytes"), F.coalesce("r.text._VALUE", F.lit("")).alias("text"),
    )
    numbers = _numbers(spark, path) if not staged else rows.select(F.col("r.id").alias("revision_id"))
    once = lambda: _first_of_each(numbers, revision).join(db, F.lit(True)).select("db_name", *revision.columns)
    named = rows.where(author["id"].isNotNull()).select(author["id"].alias("contributor_id"), author["username"].alias("name"), F.struct("r.timestamp", "r.id").alias("at"))
    contributor = named.groupBy("contributor_id").agg(F.min_by("name", "at").alias("name")).join(db, F.lit(True)).select("db_name", "contributor_id", "name")
    return Tables({"wiki": lambda: wiki, "namespace": lambda: namespace, "page": lambda: page, "revision": cache(once), "contributor": lambda: contributor})


class Tables(Mapping):
    """Tables by name; each is made when it is asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers = makers

    def __getitem__(self, name: str) -> DataFrame:
        return self._makers[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def _numbers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``revision_id`` of all revisions in the files, whatever their pages, and perhaps of some that are cut off."""
    value = F.substr("value", F.locate("<revision>", F.col("value")) + len("<revision>"))
    number = F.regexp_extract("value", r"<revision>\s*<id>([0-9]{1,18})</id>", 1)
    held = _pieces(spark, path).where(F.col("value").contains("<revision>"))
    return held.select(F.when(number != "", number.cast("long")).otherwise(_element("revision", value, _revision)["id"]).alias("revision_id"))


#: Ids of repeated revisions up to so many are sent to all executors; more are joined by shuffle.
BROADCAST_IDS = 100_000


def _first_of_each(numbers: DataFrame, revision: DataFrame) -> DataFrame:
    """Each revision once. Only ids are counted, right away; of repeated ones the content with the smallest hash stays, whatever the order of the files.

    ``numbers`` may have more ids than ``revision``. Where none is repeated, as in most dumps, no revision is shuffled.
    """
    again = materialise(numbers.groupBy("revision_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("revision_id"), "repeated")
    n = again.count()
    if not n:
        return revision
    again = F.broadcast(again) if n <= BROADCAST_IDS else by_shuffle(again)
    repeated = revision.join(again, "revision_id", "left_semi")
    rest = [c for c in revision.columns if c != "revision_id"]
    first = repeated.groupBy("revision_id").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_r")).select("revision_id", "_r.*").select(revision.columns)
    return revision.join(again, "revision_id", "left_anti").unionByName(first)


def _namespaces(spark: SparkSession, site: DataFrame, aliases: dict[int, list[str]]) -> DataFrame:
    """SRC4-5: the dump's namespaces; of those with one name, the smallest id stays."""
    found = site.select(F.col("dbname").alias("db_name"), F.inline("namespaces.namespace"))
    extra = spark.createDataFrame([(k, list(v)) for k, v in aliases.items()], "ns_id int, aliases array<string>")
    rows = found.select("db_name", F.col("_key").alias("ns_id"), decoded(CASES, F.col("_case"), None, None).alias("case"), F.coalesce("_VALUE", F.lit("")).alias("name"))
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("db_name", "name").orderBy("ns_id"))).where("_n = 1").drop("_n")
    joined = rows.join(F.broadcast(extra), "ns_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return joined.select("db_name", "ns_id", "case", "name", F.col("name").alias("canonical_name"), "aliases", F.array_distinct(F.concat(F.array("name"), F.col("aliases"))).alias("all_names"))
