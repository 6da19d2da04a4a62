"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Session, path and thread of each table that is there.
_written: list[tuple[SparkSession, str, int]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the intermediate tables."""
    path = f"{shared_dir(spark).rstrip('/')}/palimpsest-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path, threading.get_ident()))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: what a task wrote is final, so values that depend
    on how rows were partitioned stay the same when executors are lost later.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df``, with the next join of it by shuffle and merge, whatever size Spark takes either side for.

    Spark goes by the size of the files, which are packed, and counts an exploded row once, so it might broadcast what doesn't fit the driver.
    """
    return df.hint("merge")


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, materialised; the intermediate tables that it wrote on the way are deleted.

    Nothing but the result may read them later. Tables that were there before stay, and so do those of other threads.
    """
    before = {path for _, path, _ in _written}
    df = make()
    passed = [x for x in _written if x[1] not in before and x[2] == threading.get_ident()]
    df = materialise(df, name)
    for x in passed:
        _written.remove(x)
        _delete(*x[:2])
    return df


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Delete the tables written so far; results that still read them become invalid."""
    while _written:
        _delete(*_written.pop()[:2])


atexit.register(release)
