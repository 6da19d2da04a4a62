"""Link layers as runs: of each edge, the stretches of consecutive layers that have it (GR4, AG4-6, JN7 of the survey).

A wiki's layers are the instants its links hold for, in order. Most edges are in many layers in a row, so a run, from its
first layer to its last, stands for many rows. Whether an edge is in a layer is a comparison with two instants. New
layers are merged into the runs without unfolding them; one that falls within a run cuts it, unless it has the edge too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.numbering import numbered
from palimpsest.storage import materialise

EDGE = ("source_id", "target_id", "link_type")
#: Layers that one merge may add; they are an array in every task.
MAX_NEW_LAYERS = 1000


def layer_list(links: DataFrame, key=()) -> DataFrame:
    """``key, ts`` of every layer, each once; layers are a wiki's, whatever their types."""
    return links.select(*key, "ts").where("ts IS NOT NULL").distinct()


def _numbers(layers: DataFrame, key) -> DataFrame:
    """``key, ts, number``: the layers in order; a number is missing between the layers of two wikis."""
    order = [*key, "ts"]
    found = numbered(layers.select(*order).distinct(), order)
    if not key:
        return found
    # Wikis are set apart, so that no run goes on from one wiki's last layer to the next one's first.
    wikis = numbered(found.select(*key).distinct(), list(key), "_wiki")
    return found.join(wikis, list(key)).select(*order, (F.col("number") + F.col("_wiki")).alias("number"))


def _joined(spans: DataFrame, numbers: DataFrame, key) -> DataFrame:
    """Runs from spans of numbers (``first, last``) that may overlap or touch; an edge has at most as many as there are layers."""
    edge = [*key, *EDGE]
    before = F.max("last").over(W.partitionBy(*edge).orderBy("first").rowsBetween(W.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("first") > before + 1), 1).otherwise(0)
    run = F.sum("_begins").over(W.partitionBy(*edge).orderBy("first").rowsBetween(W.unboundedPreceding, W.currentRow))
    merged = spans.withColumn("_begins", begins).withColumn("_run", run).groupBy(*edge, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    named = lambda name: numbers.select(*key, F.col("number").alias(name), F.col("ts").alias(f"{name}_layer"))
    placed = merged.join(named("first"), [*key, "first"]).join(named("last"), [*key, "last"])
    return placed.select(*edge, "first_layer", "last_layer", (F.col("last") - F.col("first") + 1).alias("n_layers"))


def runs(links: DataFrame, layers: DataFrame | None = None, key=()) -> DataFrame:
    """``key, source_id, target_id, link_type, first_layer, last_layer, n_layers`` of links (with ``ts``); repeated links count once.

    ``layers`` (``key, ts``) has layers without links too; by default all are those of the links.
    """
    numbers = materialise(_numbers(layer_list(links, key) if layers is None else layers, key), "layers")
    at = links.select(*key, *EDGE, "ts").distinct().join(numbers, [*key, "ts"])
    return _joined(at.select(*key, *EDGE, F.col("number").alias("first"), F.col("number").alias("last")), numbers, key)


def merged_runs(stored: DataFrame, layers: DataFrame, links: DataFrame, key=()) -> DataFrame:
    """GR4 on runs: ``stored``, which are runs over ``layers``, with the links of new layers; links of known layers are added as well.

    No run is unfolded: runs are cut where new layers fall between their ends, new links are spans of one layer, and spans
    that touch in the new order are joined. ``layer_list`` of both makes the new list of layers.
    """
    new = layer_list(links, key).join(layers, [*key, "ts"], "left_anti")
    numbers = materialise(_numbers(layers.select(*key, "ts").unionByName(layer_list(links, key)), key), "layers")
    added = [r[0] for r in numbers.join(new, [*key, "ts"], "left_semi").select("number").distinct().limit(MAX_NEW_LAYERS + 1).collect()]
    if len(added) > MAX_NEW_LAYERS:
        raise ValueError(f"more than {MAX_NEW_LAYERS} new layers at once")
    named = lambda name: numbers.select(*key, F.col("ts").alias(f"{name}_layer"), F.col("number").alias(name))
    held = stored.join(named("first"), [*key, "first_layer"]).join(named("last"), [*key, "last_layer"])
    inside = F.filter(F.array(*[F.lit(n).cast("long") for n in sorted(added)]), lambda n: (n > F.col("first")) & (n < F.col("last"))) if added else F.array().cast("array<bigint>")
    starts, ends = F.concat(F.array("first"), F.transform(inside, lambda n: n + 1)), F.concat(F.transform(inside, lambda n: n - 1), F.array("last"))
    pieces = F.filter(F.arrays_zip(starts.alias("first"), ends.alias("last")), lambda p: p["first"] <= p["last"])
    cut = held.select(*key, *EDGE, F.inline(pieces))
    at = links.select(*key, *EDGE, "ts").distinct().join(numbers, [*key, "ts"])
    return _joined(cut.unionByName(at.select(*key, *EDGE, F.col("number").alias("first"), F.col("number").alias("last"))), numbers, key)


def covers(at: Column) -> Column:
    """Whether a run has the layer ``at``, which must be one of the wiki's."""
    return (F.col("first_layer") <= at) & (F.col("last_layer") >= at)


def edges_at(runs_: DataFrame, layer, types=(), key=()) -> DataFrame:
    """JN7 on runs: the links of one layer, with its ``ts``."""
    at = F.lit(layer).cast(runs_.schema["first_layer"].dataType)
    rows = runs_.where(covers(at))
    rows = rows.where(F.col("link_type").isin(*types)) if types else rows
    return rows.select(*key, *EDGE, at.alias("ts"))


def layer_counts(runs_: DataFrame, key=()) -> DataFrame:
    """AG4 on runs: ``n_layers, first_layer, last_layer`` of every edge, without a list of its layers."""
    return runs_.groupBy(*key, *EDGE).agg(F.sum("n_layers").alias("n_layers"), F.min("first_layer").alias("first_layer"), F.max("last_layer").alias("last_layer"))


def layer_types(runs_: DataFrame, layers: DataFrame, key=()) -> DataFrame:
    """AG6 on runs: which layers have links of which types. A type's runs are joined to spans first, of which there are few."""
    numbers = materialise(_numbers(layers, key), "layers")
    named = lambda name: numbers.select(*key, F.col("ts").alias(f"{name}_layer"), F.col("number").alias(name))
    distinct = runs_.select(*key, "link_type", "first_layer", "last_layer").distinct().join(named("first"), [*key, "first_layer"]).join(named("last"), [*key, "last_layer"])
    spans = distinct.select(*key, "link_type", "first", "last").withColumn("source_id", F.lit(0)).withColumn("target_id", F.lit(0))
    joined = _joined(spans, numbers, key).join(named("first"), [*key, "first_layer"])
    every = joined.select(*key, "link_type", F.explode(F.sequence("first", F.col("first") + F.col("n_layers") - 1)).alias("number"))
    return every.join(numbers, [*key, "number"]).select(*key, "link_type", "ts")
