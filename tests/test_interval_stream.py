"""Intervals kept by a stream are those of the whole table, whatever the order of arrival."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import history
from palimpsest.streaming import incremental


@pytest.mark.parametrize("seed", range(2))
def test_intervals_of_a_stream(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(p, 100 * p + k, r.randrange(1, 30)) for p in range(4) for k in range(r.randrange(1, 12))]
    r.shuffle(rows)
    source, target, checkpoint = (f"{tmp_path}/{x}" for x in ("source", "target", "checkpoint"))
    assert incremental.intervals_of(spark, target) is None
    frame = lambda part: spark.createDataFrame(part, "page_id long, revision_id long, t long").select("page_id", "revision_id", F.timestamp_seconds("t").alias("ts"))
    seen = []
    for start in range(0, len(rows), 8):
        part = rows[start : start + 8]
        seen += part
        frame([*part, *part[:2], *seen[:1]]).write.mode("append").parquet(source)
        incremental.stream_intervals(spark.readStream.schema("page_id long, revision_id long, ts timestamp").parquet(source), target, checkpoint, once=True).awaitTermination()
        want = history.intervals(frame(seen)).select("page_id", "revision_id", "valid_from", "valid_to")
        assert sorted(map(str, incremental.intervals_of(spark, target).collect())) == sorted(map(str, want.collect()))
    # A batch that is run again, as after a failure before its commit, replaces itself.
    last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "checkpoint" / "commits").glob(f"*{last}*"):
        p.unlink()
    incremental.stream_intervals(spark.readStream.schema("page_id long, revision_id long, ts timestamp").parquet(source), target, checkpoint, once=True).awaitTermination()
    assert sorted(map(str, incremental.intervals_of(spark, target).collect())) == sorted(map(str, want.collect()))


def test_only_touched_buckets_are_read_and_batches_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "TOGETHER", 2)
    source, target, checkpoint = (f"{tmp_path}/{x}" for x in ("source", "target", "checkpoint"))
    schema = "page_id long, revision_id long, ts timestamp"
    frame = lambda rows: spark.createDataFrame(rows, "page_id long, revision_id long, t long").select("page_id", "revision_id", F.timestamp_seconds("t").alias("ts"))
    batches = [[(p, 10 * p, 50) for p in range(40)], [(3, 31, 20)], [(3, 32, 90), (5, 51, 10)], [], [(7, 71, 60)], [(3, 33, 55)]]
    seen = []
    for part in batches:
        seen += part
        frame(part or [(None, None, None)]).write.mode("append").parquet(source)  # a batch without a usable row
        incremental.stream_intervals(spark.readStream.schema(schema).parquet(source), target, checkpoint, once=True).awaitTermination()
        want = history.intervals(frame(seen)).select("page_id", "revision_id", "valid_from", "valid_to")
        assert sorted(map(str, incremental.intervals_of(spark, target).collect())) == sorted(map(str, want.collect()))
    assert sorted(p.name for p in (tmp_path / "target" / "together").iterdir()) == ["upto=2", "upto=4"]
    # The state before an earlier batch can still be read.
    early = history.intervals(frame(batches[0] + batches[1])).select("page_id", "revision_id", "valid_from", "valid_to")
    assert sorted(map(str, incremental.intervals_of(spark, target, before=2).collect())) == sorted(map(str, early.collect()))
    bucket = frame(batches[1]).select(incremental._bucket(("page_id",))).first()["bucket"]
    one = incremental.intervals_of(spark, target, buckets=[bucket])
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?)\]", plan)
    assert filters and all("bucket#" in f for f in filters)
    assert {r.page_id for r in one.collect()} >= {3} and one.count() < len(seen)
    # A half-written folder is not read.
    (tmp_path / "target" / "together" / "upto=4" / "_SUCCESS").unlink()
    assert incremental._complete(spark, target) == [2]
    assert sorted(map(str, incremental.intervals_of(spark, target).collect())) == sorted(map(str, want.collect()))
