"""The wiki tables of a folder (SRC2-3, SRC13, SRC15, SNK9, SET2, JN13 of the survey).

Every import writes Parquet files into folders of its own and then adds one entry to a log, which names them. Only what the log
names is read, so an import that fails or is killed leaves nothing half. Entries are numbered and put
in place by a rename that fails if the number is taken; an import that finds its number taken tests its rows
again, against the longer log, and tries the next number.

Within an import, rows are split by wiki, links and tiers by layer too, and then into buckets by what the table is clustered
by (``schemas.CLUSTERS``, mostly the page), and sorted by it within files. Reads of given pages or layers open only their folders.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.schemas import CLUSTERS, KEYS, LAYERED, TABLES
from palimpsest.sources import sql_dump, xml_dump
from palimpsest.storage import materialise

BUCKETS = 16
#: Ids of pages up to so many are a filter that the scan can use; more are joined.
LISTED_PAGES = 1000


def layer_name(ts: Column) -> Column:
    """The folder of an instant's rows, whatever the session's time zone."""
    return F.unix_micros(ts.cast("timestamp")).cast("string")


class Catalog:
    """Tables below a folder. An import appends what is new by key, so it may be repeated.

    Rows are compared with those of the wikis and buckets they fall into. Revisions are clustered by page, but known by
    their id alone, so their ids are compared with all of the wiki's within the same range.
    Rows of a table without a key (entity usage) may repeat; an import tops them up to as many as it has itself.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._entries: dict[int, dict] = {}

    # The log

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def log(self) -> dict[int, dict]:
        """All entries by number: ``tables`` (table to folder of the import) and ``buckets``."""
        files = self._files()
        if not files.exists(self._path("_log")):
            self._entries = {}
            return {}
        there = {int(f.getPath().getName().removesuffix(".json")) for f in files.listStatus(self._path("_log")) if f.getPath().getName().endswith(".json")}
        self._entries = {n: self._entries.get(n) or self._entry(n) for n in sorted(there)}
        return self._entries

    def _entry(self, number: int) -> dict:
        stream = self._files().open(self._path("_log", f"{number:012}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, number: int, entry: dict) -> bool:
        """Whether the entry got its number."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        temporary, target = self._path("_log", f".{uuid4().hex}"), self._path("_log", f"{number:012}.json")
        stream = self._files().create(temporary, True)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files().getUri(), conf).rename(temporary, target, no_overwrite)
        except Py4JJavaError as error:
            self._files().delete(temporary, False)
            if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
                return False
            raise
        return True

    # Reading

    def _stored(self, name: str, entries: Iterable[dict]) -> DataFrame | None:
        folders = [f"{self.folder}/{name}/import={e['tables'][name]}" for e in entries if name in e["tables"]]
        if not folders:
            return None
        schema = T.StructType([*TABLES[name].fields, T.StructField("import", T.StringType()), *([T.StructField("layer", T.StringType())] if name in LAYERED else []), T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*folders)

    def _buckets(self) -> int:
        return next((e["buckets"] for e in self._entries.values()), self.buckets)

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*CLUSTERS[name]), F.lit(self._buckets())).cast("int")

    def read(self, name: str, layer=None, ids: Iterable | None = None) -> DataFrame:
        """A table; empty if nothing was imported yet.

        ``layer``, for links and tiers, is an instant, and ``ids`` are values of what the table is clustered by, such as pages:
        folders of other layers and buckets are then not opened.
        """
        rows = self._stored(name, self.log().values())
        if rows is None:
            return self.spark.createDataFrame([], TABLES[name])
        if layer is not None:
            if name not in LAYERED:
                raise ValueError(f"{name} has no layers")
            at = F.lit(layer).cast("timestamp")
            micros = self.spark.range(1).select(layer_name(at)).first()[0]
            rows = rows.where((F.col("layer") == micros) & (F.col("ts") == at))
        if ids is not None:
            rows = self._of(name, rows, list(ids))
        return rows.select(*TABLES[name].names)

    def _of(self, name: str, rows: DataFrame, ids: list) -> DataFrame:
        (column,) = CLUSTERS[name]
        wanted = self.spark.createDataFrame([(i,) for i in ids], T.StructType([TABLES[name][column]])).where(F.col(column).isNotNull()).distinct()
        near = rows.where(F.col("bucket").isin([r[0] for r in wanted.select(self._bucket(name)).distinct().collect()]))
        if len(ids) <= LISTED_PAGES:
            return near.where(F.col(column).isin([i for i in ids if i is not None]))
        low, high = wanted.agg(F.min(column), F.max(column)).first()
        return near.where(F.col(column).between(low, high)).join(wanted, column, "left_semi")

    # Adding

    def reset(self) -> None:
        """Forget all tables."""
        for name in ("_log", *TABLES):
            self._files().delete(self._path(name), True)
        self._entries = {}

    def add(self, name: str, rows: DataFrame) -> None:
        """Append the rows whose key isn't there yet."""
        self.add_all({name: rows})

    def add_all(self, tables: dict[str, DataFrame]) -> None:
        """Append to several tables by one entry of the log: all of it is there afterwards, or nothing."""
        entries = self.log()
        new = {}
        for name, rows in tables.items():
            rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].fields])
            new[name] = materialise(self._once(name, rows).withColumn("bucket", self._bucket(name)), f"import-{name}")
        while True:
            written = {name: folder for name, rows in new.items() if (folder := self._write(name, self._unknown(name, rows, entries.values())))}
            if not written or self._commit(max(entries, default=-1) + 1, {"tables": written, "buckets": self._buckets()}):
                return
            for name, folder in written.items():  # no entry names them; others were faster
                self._files().delete(self._path(name, f"import={folder}"), True)
            entries = self.log()

    def _once(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.dropDuplicates(KEYS[name]) if KEYS[name] else rows

    def _near(self, name: str, rows: DataFrame, entries: Iterable[dict]) -> DataFrame | None:
        """Stored rows of the wikis and buckets that ``rows`` fall into."""
        there = self._stored(name, entries)
        if there is None:
            return None
        touched = rows.select("db_name", "bucket").distinct().collect()  # wikis x buckets
        wikis = {r["db_name"] for r in touched}
        there = there.where(F.col("db_name").isin([w for w in wikis if w is not None]) | (F.lit(None in wikis) & F.col("db_name").isNull()))
        if KEYS[name] and not set(CLUSTERS[name]) <= set(KEYS[name]):
            (own,) = [c for c in KEYS[name] if c != "db_name"]
            low, high = rows.agg(F.min(own), F.max(own)).first()
            return there.where(F.col(own).between(low, high))
        return there.where(F.col("bucket").isin([r["bucket"] for r in touched]))

    def _unknown(self, name: str, rows: DataFrame, entries: Iterable[dict]) -> DataFrame:
        there, key = self._near(name, rows, entries), KEYS[name]
        if there is None:
            return rows
        if key:
            same = [F.col(f"rows.{c}").eqNullSafe(F.col(f"there.{c}")) for c in key]
            return rows.alias("rows").join(there.select(*key).alias("there"), reduce(Column.__and__, same), "left_anti")
        names = TABLES[name].names
        counted = lambda df, n: df.groupBy(F.struct(*names).alias("_row"), "bucket").agg(F.count(F.lit(1)).alias(n))
        lacking = counted(rows, "_n").join(counted(there, "_there"), ["_row", "bucket"], "left").where("_n > coalesce(_there, 0)")
        return lacking.select("_row.*", "bucket", F.explode(F.sequence(F.lit(1), (F.col("_n") - F.coalesce("_there", F.lit(0))).cast("int")))).drop("col")

    def _write(self, name: str, rows: DataFrame) -> str | None:
        """Write rows into a folder that no entry names yet; None if there are none."""
        folders = ["db_name", *(["layer"] if name in LAYERED else []), "bucket"]
        order = list(dict.fromkeys([*folders, *CLUSTERS[name], *(["ts"] if "ts" in TABLES[name].names else [])]))
        rows = rows.withColumn("layer", layer_name(F.col("ts"))) if name in LAYERED else rows
        if rows.isEmpty():
            return None
        number = uuid4().hex
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(*folders).parquet(f"{self.folder}/{name}/import={number}")
        return number

    def import_dump(self, path: str | list[str], accept=None, aliases=None) -> None:
        """SRC1-8: add a wiki's XML dump files, as much as is new."""
        self.add_all(xml_dump.read_dump(self.spark, path, accept, aliases, staged=True))

    def import_links(self, *paths: str) -> None:
        """SRC14: add the links of SQL dumps; pages must have been imported."""
        pages = self.read("page")
        self.add("link", reduce(DataFrame.unionByName, [sql_dump.read_links(self.spark, p, pages) for p in paths]))

    def import_entity_usage(self, path: str, db_name: str) -> None:
        self.add("entity_usage", sql_dump.entity_usage(sql_dump.read_tuples(self.spark, path), self.read("page"), db_name))

    def register(self) -> None:
        """Make all tables temporary views, for SQL."""
        for name in TABLES:
            self.read(name).createOrReplaceTempView(name)
