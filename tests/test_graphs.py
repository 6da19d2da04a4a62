"""Closures of deep and tangled categories, and layers as runs, against brute force."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import graph, layers, links
from palimpsest.schemas import CATEGORIZATION, SENTINEL_LAYER


def category_links(spark, edges):
    rows = spark.createDataFrame(list(edges) or [(0, 0)], "target_id long, source_id long")
    rows = rows if edges else rows.where("false")
    return rows.select("source_id", "target_id", F.lit(CATEGORIZATION).alias("link_type"), F.lit(SENTINEL_LAYER).cast("timestamp").alias("ts"))


def below(edges, seeds):
    members = {}
    for above, member in edges:
        members.setdefault(above, set()).add(member)
    depth, queue = dict.fromkeys(seeds, 0), deque(seeds)
    while queue:
        page = queue.popleft()
        for m in members.get(page, ()):
            if m not in depth:
                depth[m] = depth[page] + 1
                queue.append(m)
    return {p: d for p, d in depth.items() if p not in seeds}


def closure(spark, edges, seeds, levels):
    found = graph.category_closure(category_links(spark, edges), spark.createDataFrame([(s,) for s in seeds], "page_id long"), plain_levels=levels)
    rows = [(r.page_id, r.depth) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return dict(rows)


def tangled(seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(45)]
    for k in range(4):  # chains from, to and beside the rest
        start = 100 * (k + 1)
        edges += [(start + i, start + i + 1) for i in range(12)]
    edges += [(3, 100), (112, 5), (112, 200), (7, 300), (312, 303), (412, 400), (206, 410), (1, 1)]
    return edges + edges[:5]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("levels", [0, 2])
def test_closures_of_tangled_graphs(spark, seed, levels):
    edges = tangled(seed)
    assert closure(spark, edges, [1, 3], levels) == below(edges, [1, 3])
    assert closure(spark, edges, [304, 205], levels) == below(edges, [304, 205])


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    write = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: written.append(name) or write(df, name))
    edges = [(i, i + 1) for i in range(10_000)] + [(i, 20_000 + i) for i in range(9_900, 9_905)]
    assert closure(spark, edges, [0], graph.PLAIN_LEVELS) == below(edges, [0])
    assert written.count("chains") <= 16 and len(written) < 40
    assert closure(spark, [], [0], 0) == {}


def layered(seed, wikis=2):
    r = random.Random(seed)
    rows = [(f"w{w}", s, t, "ARTICLE" if s % 2 else "REDIRECT", day) for w in range(wikis) for s in range(4) for t in range(3) for day in range(14) if r.random() < 0.8 and (w, day) not in ((0, 5), (1, 9))]
    return rows + rows[:10]


def unfolded(rows):
    days = {}
    for w, *_, day in rows:
        days.setdefault(w, set()).add(day)
    order = {w: {d: k for k, d in enumerate(sorted(ds))} for w, ds in days.items()}
    found = set()
    for edge in {r[:4] for r in rows}:
        own = sorted({r[4] for r in rows if r[:4] == edge})
        start = own[0]
        for a, b in zip(own, [*own[1:], None], strict=True):
            if b is None or order[edge[0]][b] != order[edge[0]][a] + 1:
                found.add((*edge, start, a, order[edge[0]][a] - order[edge[0]][start] + 1))
                start = b
    return found


def frame(spark, rows):
    return spark.createDataFrame(rows, "db_name string, source_id long, target_id long, link_type string, day long").select("db_name", "source_id", "target_id", "link_type", F.timestamp_seconds(F.col("day") * 86400).alias("ts"))


def days(df):
    return {(*r[:4], r.first_layer.timestamp() // 86400, r.last_layer.timestamp() // 86400, r.n_layers) for r in df.collect()}


def test_layers_as_runs(spark):
    rows = layered(1)
    df = frame(spark, rows)
    key = ("db_name",)
    found = layers.runs(df, key=key).cache()
    assert days(found) == unfolded(rows)
    counts = {tuple(r[:5]) for r in layers.layer_counts(found, key).collect()}
    assert counts == {(*e, len({r[4] for r in rows if r[:4] == e})) for e in {r[:4] for r in rows}}
    at = "1970-01-04 00:00:00"
    assert {tuple(r) for r in layers.edges_at(found, at, key=key).collect()} == {tuple(r) for r in links.distinct_links(links.at_layer(df, at), key).select("db_name", *layers.EDGE, "ts").collect()}
    assert {tuple(r) for r in layers.layer_types(found, layers.layer_list(df, key), key).collect()} == {tuple(r) for r in links.layers(df, key).collect()}
    assert layers.runs(df.where("false"), key=key).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_new_layers_are_merged_into_runs(spark, seed):
    rows = layered(seed)
    r = random.Random(seed)
    imports = {day: r.randrange(3) for day in range(14)}
    key = ("db_name",)
    parts = [frame(spark, [x for x in rows if imports[x[4]] == k]) for k in range(3)]
    stored, known = layers.runs(parts[0], key=key), layers.layer_list(parts[0], key)
    for part in (*parts[1:], parts[1]):
        stored = layers.merged_runs(stored, known, part, key)
        known = known.unionByName(layers.layer_list(part, key)).distinct()
    assert days(stored) == unfolded(rows)
