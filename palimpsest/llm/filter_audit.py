"""How five filters overlap, for every order in which they might be applied.

A document's failures are a mask of five bits. Of each part and label, 32 signed sums are taken, one for each
set of filters: a document counts as 1 or as -1, as it fails an even or an odd number of them. These are the
Walsh-Hadamard transform of the numbers of documents of each mask, and the transform is its own inverse but for a
factor of 32, so the numbers come back exactly. What each filter removes at each step of each order is a
sum over those 32 numbers. The Shapley value needs no orders: of a document's k failed filters each is
the first in 120 / k of the 120 orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.exact_dedup import digest_of
from palimpsest.storage import materialise

LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
SPACE_RUN = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2


def text_failures(text: Column) -> Column:
    """The bits of A to D of a text without null: few words, few different words, many capitals, symbols."""
    words = F.array_remove(F.split(text, SPACE_RUN), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    failed = (
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words).cast("long"),
        100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` of every row: bit i is set if it fails filter i of ``LETTERS``.

    E needs the smallest doc_id of each text. It is found by an aggregate over digests, and goes back to the one
    row that has it by (digest, doc_id), so the copies of a hot text are spread over tasks. A null doc_id is
    neither smaller nor larger than another, so such a row doesn't fail E.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_failures(text).alias("mask"), digest_of(text).alias("digest"))
    rows = materialise(narrow, "audit-masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("_first", F.lit(True))
    copy = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, MASKS >> 1).otherwise(0)).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``; no label means neither, and of several labels each counts."""
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    found = rows.join(marks, "doc_id", "left")
    return found.select(*rows.columns, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _sign(mask: Column, chosen: Column) -> Column:
    return F.lit(1).cast("long") - 2 * (F.bit_count(mask.bitwiseAND(chosen)) % 2)


def parity_sums(rows: DataFrame) -> DataFrame:
    """``part, good, toxic, sums``: the 32 signed sums of each part and label, combined within tasks first."""
    sums = [F.sum(_sign(F.col("mask"), F.lit(s))).alias(f"s{s}") for s in range(MASKS)]
    return rows.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*[f"s{s}" for s in range(MASKS)]).alias("sums"))


def mask_cells(parities: DataFrame) -> DataFrame:
    """The inverse: ``part, good, toxic, mask, n`` for all 32 masks, zeros included."""
    every = F.array(*[F.lit(s) for s in range(MASKS)])
    total = F.aggregate(F.zip_with("sums", every, lambda value, s: value * _sign(F.col("mask"), s)), F.lit(0).cast("long"), lambda a, b: a + b)
    return parities.select("*", F.explode(every).alias("mask")).select("part", "good", "toxic", "mask", F.shiftright(total, len(LETTERS)).alias("n"))


STEP = T.ArrayType(
    T.StructType([T.StructField(name, T.StringType() if name == "filter_order" else T.IntegerType()) for name in ("filter_order", "step", "own", "before")])
)


def _steps() -> Column:
    """Every step of every order: its filter's bit, and the bits of the filters before it."""
    bit = {letter: 1 << i for i, letter in enumerate(LETTERS)}
    found = [F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(bit[letter]).alias("own"), F.lit(sum(bit[x] for x in order[:k])).alias("before")) for order in permutations(LETTERS) for k, letter in enumerate(order)]
    return F.array(*found).cast(STEP)


def orders(cells: DataFrame) -> DataFrame:
    """What each step of each order keeps, removes and loses, from the cells of each part: 600 rows a part."""
    counted = cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 of each part
    steps = parts.select("part", "cells", F.explode(_steps()).alias("at")).select("part", "cells", "at.*")
    own, before = F.col("own"), F.col("before")

    def total(keep, value=lambda cell: cell["n"]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, cell: sum_ + F.when(keep(cell["mask"]), value(cell)).otherwise(0))

    fails = lambda mask: mask.bitwiseAND(own) != 0
    passed = lambda mask: mask.bitwiseAND(before) == 0
    removed = lambda mask: passed(mask) & fails(mask)
    everyone = factorial(len(LETTERS))
    return steps.select(
        "part", "filter_order", "step", total(lambda m: passed(m) & ~fails(m)).alias("kept"), total(removed).alias("removed"), total(lambda m: ~passed(m) & fails(m)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"), total(removed, lambda c: c["good"]).alias("good_lost"), total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["n"] * (F.lit(everyone) / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs`` (``doc_id, text, source``): one row per part, order and step.

    Null text is empty and null source the empty string. Repeated doc_ids count as often as they come, each with the
    labels of its id; if they share the smallest id of a text, none of them is a copy. Labels without a
    document count nothing. An empty table gives an empty result; other columns are ignored.
    """
    parities = materialise(parity_sums(labelled(masks(docs), labels)), "audit-parities")  # 32 numbers a part and label
    return orders(mask_cells(parities))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS copy FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * copy::INT AS mask
  FROM w LEFT JOIN l USING (doc_id)
),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT [a, b, c, d, e] AS bits, a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM (
    SELECT f1 AS a, f2 AS b, f3 AS c, f4 AS d, f5 AS e FROM f f1, f f2, f f3, f f4, f f5
    WHERE f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31 AND f1.bit | f2.bit | f3.bit | f4.bit | f5.bit = 31)
),
s AS (SELECT filter_order, k AS step, bits[k].bit AS own, coalesce(list_sum(list_transform(bits[1:k - 1], lambda x: x.bit)), 0)::INT AS before FROM o, range(1, 6) r(k)),
c AS (
  SELECT part, filter_order, step::INT AS step, own, count(*) FILTER (mask & (before | own) = 0) AS kept, count(*) FILTER (mask & before = 0 AND mask & own <> 0) AS removed,
         count(*) FILTER (mask & before <> 0 AND mask & own <> 0) AS redundant, count(*) FILTER (mask = own) AS unique_fails,
         count(*) FILTER (mask & before = 0 AND mask & own <> 0 AND good = 1) AS good_lost, count(*) FILTER (mask & before = 0 AND mask & own <> 0 AND toxic = 1) AS toxic_lost
  FROM m, s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM c
"""
