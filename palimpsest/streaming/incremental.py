"""Files that arrive over time, added to the catalog (ST1-2, ST4-5 of the survey).

A stream delivers each new file once; each micro-batch is added by key, so a batch that is
run again after a failure adds nothing twice. Order on arrival doesn't matter, since
revisions are ordered by time when they are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions.codecs import compress
from palimpsest.operators.history import PAGE_KEY, distinct_revisions, intervals
from palimpsest.schemas import TABLES
from palimpsest.sources import xml_dump
from palimpsest.sources.catalog import Catalog

Listener = Callable[[str, DataFrame], None]
CompressionListener = Callable[[int, DataFrame], None]
#: Buckets of pages in a stream's table of intervals, and batches after which their newest rows are put together.
BUCKETS, TOGETHER = 64, 50


def import_files(catalog: Catalog, name: str, folder: str, checkpoint: str, listener: Listener | None = None, once: bool = False) -> StreamingQuery:
    """Add JSON files of table ``name`` as they arrive; ``once`` ends when all that is there is in.

    A listener gets each batch's new rows before they are added.
    """
    rows = catalog.spark.readStream.schema(TABLES[name]).json(folder)

    def add(batch: DataFrame, _: int) -> None:
        if listener is not None:
            listener(name, batch)
        catalog.add(name, batch)

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def import_events(name: str, rows: DataFrame) -> DataFrame:
    """ST1: ``event, db_name, number`` of the rows of an imported table, for a listener of ``import_files``.

    Revisions tell whether a registered user or an address made them; ``number`` is the id of the namespace, page, revision or
    contributor, null for a wiki. Tables that come without ids (tiers, links, usage) give their name only.
    """
    ids = {"namespace": "ns_id", "page": "page_id", "revision": "revision_id", "contributor": "contributor_id"}
    event = F.when(F.col("contributor_id").isNull(), "revision by address").otherwise("revision by user") if name == "revision" else F.lit(name)
    return rows.select(event.alias("event"), "db_name", (F.col(ids[name]) if name in ids else F.lit(None)).cast("long").alias("number"))


def import_dumps(catalog: Catalog, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Add whole XML dump files as they arrive, in any order; a wiki may come in many files, of which a batch's are read together."""
    files = catalog.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")

    def add(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.distinct().collect()]  # names of the files of one batch
        for own in xml_dump.files_by_wiki(catalog.spark, paths).values():
            catalog.import_dump(own)

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def compress_files(catalog: Catalog, folder: str, target: str, checkpoint: str, codec: str, listener: CompressionListener | None = None, once: bool = False) -> StreamingQuery:
    """ST2: compress the texts of revision files as they arrive, into Parquet below ``target``, one folder a batch.

    When a batch is stored, the listener gets its number and the completed rows: ``db_name, page_id, revision_id, codec,
    raw_bytes, stored_bytes``. A batch that runs again after a failure replaces what it had written.
    """
    rows = catalog.spark.readStream.schema(TABLES["revision"]).json(folder)

    def store(batch: DataFrame, number: int) -> None:
        path = f"{target.rstrip('/')}/batch={number}"
        packed = batch.select("db_name", "page_id", "revision_id", F.lit(codec).alias("codec"), F.octet_length("text").cast("long").alias("raw_bytes"), compress(F.col("text"), codec).alias("data"))
        packed.write.mode("overwrite").parquet(path)
        if listener is not None:
            done = catalog.spark.read.schema(packed.schema).parquet(path)
            listener(number, done.select(*[c for c in done.columns if c != "data"], F.octet_length("data").cast("long").alias("stored_bytes")))

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _bucket(key) -> Column:
    return F.pmod(F.hash(*key), F.lit(BUCKETS)).alias("bucket")


def stream_intervals(revisions: DataFrame, target: str, checkpoint: str, key=PAGE_KEY, once: bool = False) -> StreamingQuery:
    """ST5/TT8: the interval of every revision (``key, ts, revision_id``), corrected as revisions arrive in whatever order.

    The state is the table below ``target``: each batch adds the intervals of its own revisions, and anew those of the revisions
    before them in time, whose ends change. Which these are is found by joining the batch's pages with what is stored, each revision's newest row;
    of that only the buckets of pages that the batch touches are opened. Every ``TOGETHER`` batches the newest rows are put
    together, so a batch reads at most that many folders, however long the stream runs; older folders stay for ``intervals_of`` before some batch. A batch
    that runs again after a failure replaces what it had written; revisions that arrive twice count once.
    """
    spark = revisions.sparkSession
    names = [*key, "revision_id", "ts"]

    def settle(batch: DataFrame, number: int) -> None:
        if number and number % TOGETHER == 0:
            _put_together(spark, target, number, key)
        new = batch.select(*names).where(F.col("ts").isNotNull()).persist()
        try:
            touched = [r["bucket"] for r in new.select(_bucket(key)).distinct().collect()]  # at most BUCKETS numbers
            known = intervals_of(spark, target, before=number, key=key, buckets=touched)
            rows = new if known is None else new.unionByName(known.join(new.select(*key).distinct(), list(key), "left_semi").select(*key, "revision_id", F.col("valid_from").alias("ts")))
            now = intervals(distinct_revisions(rows, key).drop("_at"), key).select(*key, "revision_id", "valid_from", "valid_to")
            if known is not None:  # only what is new or has another end
                now = now.join(known, now.columns, "left_anti")
            _write(now, f"{target.rstrip('/')}/changes/batch={number}", key)
        finally:
            new.unpersist()

    writer = revisions.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _write(rows: DataFrame, path: str, key) -> None:
    # Rebalancing splits the bucket of a page with very many rows and joins small ones.
    rows.select("*", _bucket(key)).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def _folders(spark: SparkSession, folder: str, name: str) -> dict[int, set[str]]:
    """The folders ``name=number`` below ``folder``, with the names of what is in each."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return {}
    found = [f.getPath() for f in files.listStatus(path) if f.getPath().getName().startswith(f"{name}=")]
    return {int(p.getName().removeprefix(f"{name}=")): {f.getPath().getName() for f in files.listStatus(p)} for p in found}


def _complete(spark: SparkSession, target: str) -> list[int]:
    """The batches before which all newest rows were put together; what was broken off has no mark and is not read."""
    return [n for n, inside in _folders(spark, f"{target.rstrip('/')}/together", "upto").items() if "_SUCCESS" in inside]


def _put_together(spark: SparkSession, target: str, number: int, key) -> None:
    if number in _complete(spark, target):
        return
    rows = intervals_of(spark, target, before=number, key=key)
    if rows is not None:
        _write(rows, f"{target.rstrip('/')}/together/upto={number}", key)


def intervals_of(spark: SparkSession, target: str, before: int | None = None, key=PAGE_KEY, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest interval of every revision in a table of ``stream_intervals``; None if nothing was written (before a batch).

    With ``buckets``, only files of these buckets of pages are read.
    """
    root = target.rstrip("/")
    since = max((n for n in _complete(spark, target) if before is None or n <= before), default=0)
    batches = [n for n, inside in _folders(spark, f"{root}/changes", "batch").items() if n >= since and (before is None or n < before) and any(x.startswith("bucket=") for x in inside)]
    parts = []
    if since:
        parts.append(spark.read.option("basePath", f"{root}/together").parquet(f"{root}/together/upto={since}").withColumn("batch", F.lit(since - 1)).drop("upto"))
    if batches:
        parts.append(spark.read.option("basePath", f"{root}/changes").parquet(*[f"{root}/changes/batch={n}" for n in sorted(batches)]))
    if not parts:
        return None
    rows = reduce(DataFrame.unionByName, parts)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    # Of a revision that came with several times, each is one.
    newest = rows.groupBy(*key, "revision_id", "valid_from").agg(F.max_by("valid_to", "batch").alias("valid_to"))
    return newest.select(*key, "revision_id", "valid_from", "valid_to")
