"""MySQL dumps of link tables (SRC9-14 of the survey)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import spaced
from palimpsest.schemas import ARTICLE, CATEGORIZATION, CATEGORY_NS, REDIRECT, SENTINEL_LAYER

_start = re.compile(r"^INSERT INTO .*?\bVALUES\s*", re.I | re.S).match
_field = re.compile(r"\s*(?:'((?:[^'\\]|\\.|'')*+)'|([^,()']*+))\s*([,)])", re.S).match
_escape = re.compile(r"\\(.)|''", re.S)


def _plain(quoted: str) -> str:
    return _escape.sub(lambda m: m[1] or "'", quoted) if "\\" in quoted or "''" in quoted else quoted


def tuples(line: str) -> Iterator[list[str | None]]:
    """The rows of one INSERT line; a column list in front of VALUES isn't a row, and NULL is None."""
    if not (m := _start(line)):
        return
    at = line.find("(", m.end())
    while at >= 0:
        row, at = [], at + 1
        while m := _field(line, at):
            at = m.end()
            row.append(_plain(m[1]) if m[1] is not None else None if m[2].strip().upper() == "NULL" else m[2].strip())
            if m[3] == ")":
                yield row
                break
        else:
            raise ValueError(f"malformed tuple near {line[at : at + 40]!r}")
        at = line.find("(", at)


def read_tuples(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: ``fields`` (array of string) of every tuple of a dump's INSERT lines."""
    lines = spark.read.text(path).where(F.col("value").startswith("INSERT INTO "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch["value"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(list(tuples(line)), pa.list_(pa.string()))], names=["fields"])

    return lines.mapInArrow(run, "fields array<string>")


def _number(i: int) -> Column:
    return F.get("fields", F.lit(i)).try_cast("long")


def _resolved(rows: DataFrame, pages: DataFrame, kind: str, db_name: str) -> DataFrame:
    """Links whose two ends are pages of the wiki, in the layer of the present."""
    own = pages.where(F.col("db_name") == db_name)
    targets = own.groupBy(F.col("ns_id").alias("target_ns"), F.col("title").alias("target_title")).agg(F.min("page_id").alias("target_id"))
    known = rows.join(own.select(F.col("page_id").alias("source_id")), "source_id", "left_semi").join(targets, ["target_ns", "target_title"])
    layer = F.lit(SENTINEL_LAYER).cast("timestamp")
    return known.select(F.lit(db_name).alias("db_name"), "source_id", "target_id", F.lit(kind).alias("link_type"), layer.alias("ts")).distinct()


def page_links(rows: DataFrame, pages: DataFrame, db_name: str) -> DataFrame:
    """SRC10: ARTICLE links; fields from, namespace, title."""
    return _resolved(rows.select(_number(0).alias("source_id"), _number(1).cast("int").alias("target_ns"), spaced(F.get("fields", F.lit(2))).alias("target_title")), pages, ARTICLE, db_name)


def category_links(rows: DataFrame, pages: DataFrame, db_name: str) -> DataFrame:
    """SRC11: CATEGORIZATION links; fields from, category title."""
    return _resolved(rows.select(_number(0).alias("source_id"), F.lit(CATEGORY_NS).alias("target_ns"), spaced(F.get("fields", F.lit(1))).alias("target_title")), pages, CATEGORIZATION, db_name)


def redirects(rows: DataFrame, pages: DataFrame, db_name: str, strict_null: bool = False) -> DataFrame:
    """SRC12: REDIRECT links within the wiki; fields from, namespace, title, interwiki.

    A NULL interwiki field is empty; with ``strict_null`` such rows are skipped.
    """
    interwiki = F.get("fields", F.lit(3))
    local = (interwiki == "") if strict_null else F.coalesce(interwiki, F.lit("")) == ""
    return _resolved(rows.where(local).select(_number(0).alias("source_id"), _number(1).cast("int").alias("target_ns"), spaced(F.get("fields", F.lit(2))).alias("target_title")), pages, REDIRECT, db_name)


def entity_usage(rows: DataFrame, pages: DataFrame, db_name: str) -> DataFrame:
    """SRC13: which entities pages use; fields 1 entity, 2 aspect, 3 page. Repeats stay."""
    own = pages.where(F.col("db_name") == db_name).select("page_id")
    used = rows.select(_number(3).alias("page_id"), F.get("fields", F.lit(1)).alias("entity_id"), F.get("fields", F.lit(2)).alias("aspect"))
    return used.join(own, "page_id", "left_semi").select(F.lit(db_name).alias("db_name"), "page_id", "entity_id", "aspect")


READERS = {"categorylinks": category_links, "pagelinks": page_links, "redirect": redirects}


def read_links(spark: SparkSession, path: str, pages: DataFrame) -> DataFrame:
    """SRC14: links of a dump file, by its name: the wiki up to the first hyphen, the table somewhere behind."""
    name = path.rstrip("/").rpartition("/")[2]
    reader = next((r for table, r in READERS.items() if table in name), None)
    if reader is None:
        raise ValueError(f"{name} names none of {', '.join(READERS)}")
    return reader(read_tuples(spark, path), pages, name.partition("-")[0])
