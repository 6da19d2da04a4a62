"""Look-ups by key and name (FLT1-14, JN13, AG2, AG9, SET4 of the survey): filters and equi-joins that reach the scan.

Each returns a DataFrame of the rows found, none if there are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import normal_title
from palimpsest.operators.links import split_namespace
from palimpsest.schemas import KEYS


def wiki_by_name(wikis: DataFrame, db_name: str) -> DataFrame:
    """FLT1."""
    return wikis.where(F.col("db_name") == db_name)


def namespace_by_name(namespaces: DataFrame, name: str) -> DataFrame:
    """FLT2: by any of its names, case-sensitive."""
    return namespaces.where(F.array_contains("all_names", name))


def namespace_names(namespaces: DataFrame) -> DataFrame:
    """FLT3: ``db_name, any_name, ns_id``: every name that a namespace goes by."""
    return namespaces.select("db_name", F.explode("all_names").alias("any_name"), "ns_id").distinct()


def pages_by_id(pages: DataFrame, ids: list[int]) -> DataFrame:
    """FLT4."""
    return pages.where(F.col("page_id").isin(*ids))


def pages_by_title(pages: DataFrame, namespaces: DataFrame, ns_id: int, title: str) -> DataFrame:
    """FLT5: the title as the namespace would store it; of several pages the one with the smallest id."""
    own = namespaces.where(F.col("ns_id") == ns_id).select("db_name", "ns_id", "case").dropDuplicates(["db_name", "ns_id"])
    wanted = own.select("db_name", "ns_id", normal_title(F.lit(title), F.col("case")).alias("title"))
    found = pages.join(F.broadcast(wanted), ["db_name", "ns_id", "title"], "left_semi")
    first = found.groupBy("db_name").agg(F.min("page_id").alias("page_id"))
    return found.join(F.broadcast(first), ["db_name", "page_id"], "left_semi")


def pages_by_qualified_titles(pages: DataFrame, namespaces: DataFrame, titles: DataFrame) -> DataFrame:
    """FLT6: ``titles`` has ``db_name, target``; a known namespace name before a colon is a prefix. Adds ``page_id`` (null: none)."""
    named = split_namespace(titles, namespaces, key=("db_name",))
    targets = pages.groupBy("db_name", F.col("ns_id").alias("target_ns"), F.col("title").alias("target_title")).agg(F.min("page_id").alias("page_id"))
    return named.join(targets, ["db_name", "target_ns", "target_title"], "left").select(*titles.columns, "page_id")


def revisions_by_id(revisions: DataFrame, ids: list[int]) -> DataFrame:
    """FLT7."""
    return revisions.where(F.col("revision_id").isin(*ids))


def contributors_named(contributors: DataFrame, name: str) -> DataFrame:
    """FLT8."""
    return contributors.where(F.col("name") == name)


def entities(usage: DataFrame) -> DataFrame:
    """FLT9: all entities that pages use."""
    return usage.select("entity_id").distinct()


def in_namespaces(pages: DataFrame, ids=(), empty_means_all: bool = True) -> DataFrame:
    """FLT10/FLT14: pages of some namespaces; what no ids mean differs between scans and tier filters."""
    if not ids:
        return pages if empty_means_all else pages.limit(0)
    return pages.where(F.col("ns_id").isin(*ids))


def contributors(rows: DataFrame, ids=()) -> DataFrame:
    """FLT8/FLT11: contributors by id; no ids scan all."""
    return rows.where(F.col("contributor_id").isin(*ids)) if ids else rows


def by_unique_id(tables: dict[str, DataFrame], unique_id: str) -> DataFrame:
    """FLT12: the row that a unique id names: the table, then the row's key columns, all divided by colons."""
    name, *values = unique_id.split(":")
    if name not in tables:
        raise ValueError(f"no such table: {name}")
    key = [c for c in KEYS[name] or ["db_name", "page_id", "entity_id", "aspect"] if c in tables[name].columns]
    if len(values) < len(key):
        raise ValueError(f"{name} needs {', '.join(key)}")
    # The last value may hold colons itself, as names and instants do.
    values = values[: len(key) - 1] + [":".join(values[len(key) - 1 :])]
    rows = tables[name]
    for column, value in zip(key, values, strict=True):
        rows = rows.where(F.col(column) == F.lit(value).cast(rows.schema[column].dataType))
    return rows


def unknown(rows: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """JN13: rows whose key isn't among the known ones."""
    return rows.join(known.select(*key).distinct(), key, "left_anti")


def pages_by_namespace(pages: DataFrame) -> DataFrame:
    """AG2: ``ns_id, n_pages``."""
    return pages.groupBy("ns_id").agg(F.count(F.lit(1)).alias("n_pages"))


def token_union(counted: DataFrame, key: list[str]) -> DataFrame:
    """SET4: ``key, tokens``: the sorted set of tokens that the term maps of a group have."""
    tokens = counted.select(*key, F.explode(F.map_keys("terms")).alias("_t")).distinct()
    return tokens.groupBy(*key).agg(F.array_sort(F.collect_set("_t")).alias("tokens"))


def term_counts(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """AG9: ``key, terms``: how often each white-space-delimited token occurs, as a map."""
    tokens = rows.select(*key, F.explode(F.filter(F.split(F.col(text), r"\s+"), lambda t: t != "")).alias("_t"))
    counted = tokens.groupBy(*key, "_t").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return counted.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_t", "_n"))).alias("terms"))
