"""As-of requests and sequences against brute force, repeated revisions on both sides of the window limit."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import history


def made(n_pages=6, hot=400, seed=3):
    r = random.Random(seed)
    rows = [(p, 1000 * p + k, r.randrange(60), f"text {p} {k}") for p in range(n_pages) for k in range(hot if p == 2 else r.randrange(6))]
    return [*rows, (1, 7, None, "no time"), (None, 8, 5, "no page")]


REVISIONS = made()
REQUESTS = [(i, p, t, f"x{i}") for i, (p, t) in enumerate([(2, t) for t in range(-1, 61)] * 8 + [(p, t) for p in (0, 1, 3, 4, 5, 99) for t in (-1, 0, 30, 60)] + [(None, 9), (2, None), (None, 4)] + [(2, 30)] * 300)]


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_as_of_requests(spark, partitions):
    revisions = spark.createDataFrame([*REVISIONS, *REVISIONS[:200]], "page_id long, revision_id long, ts long, text string").repartition(7)
    requests = spark.createDataFrame([*REQUESTS, REQUESTS[5]], "request long, page_id long, at long, `_page` string").withColumn("a.b", F.lit(1)).withColumn("title", F.lit(1))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that ranges are not put together
    try:
        got = sorted(tuple(r) for r in history.revision_as_of(requests, revisions, columns=("revision_id", "ts", "text")).select("request", "revision_id", "ts", "text").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = []
    for i, p, t, _ in [*REQUESTS, REQUESTS[5]]:
        found = max(((r[2], r[1], r[3]) for r in REVISIONS if r[0] == p and t is not None and r[2] is not None and r[2] <= t), default=(None, None, None))
        want.append((i, found[1], found[0], found[2]))
    assert got == sorted(want)


def test_as_of_keeps_columns_and_takes_empty_tables(spark):
    revisions = spark.createDataFrame(REVISIONS, "page_id long, revision_id long, ts long, text string")
    requests = spark.createDataFrame(REQUESTS, "request long, page_id long, at long, note string").withColumn("_last", F.lit(2)).withColumn("a.b", F.lit(1))
    assert history.revision_as_of(requests, revisions).columns == [*requests.columns, "ts", "revision_id"]
    assert history.revision_as_of(requests.where("false"), revisions).count() == 0
    none = history.revision_as_of(requests, revisions.where("false"), columns=("text", "revision_id"))
    assert none.count() == len(REQUESTS) and none.where("text IS NOT NULL OR revision_id IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        history.revision_as_of(requests, revisions, columns=("note",))


def test_repeats_count_once_on_both_sides_of_the_limit(spark, monkeypatch):
    rows = [(1, k, k // 2, "b") for k in range(9)] + [(1, 3, 1, "a"), (1, 3, 1, "b"), (1, 4, None, "n"), (1, 4, None, "n"), (2, 1, 1, "x"), (2, 1, 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, revision_id long, ts long, text string").repartition(3)
    stamped = df.withColumn("ts", F.timestamp_seconds("ts"))
    starts = spark.createDataFrame([(1, 3), (2, 1), (2, 9)], "page_id long, revision_id long")

    def all_of():
        return [
            sorted(map(str, f.collect()))
            for f in (history.positions(df), history.neighbours(df), history.intervals(stamped), history.key_frames(df, 4), history.sequence_from(df, starts), history.sequenced(df, carry=("text",)))
        ]

    want = all_of()
    assert [len(x) for x in want[:4]] == [11] * 4
    monkeypatch.setattr(history, "WINDOW_ROWS", 3)
    assert history.crowded(df) and all_of() == want
