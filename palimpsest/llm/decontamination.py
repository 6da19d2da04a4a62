"""Which documents hold passages of a benchmark.

Texts are words of ASCII digits, letters and everything beyond ASCII, with A to Z in lower case. A window is ten
consecutive words of an item, or all words of a shorter one. The windows of all items, as sequences of word
numbers, are the patterns of one Aho-Corasick automaton, which reads each text once; words that no item has are
number 0. Places of words map back to places of the original text.

Windows are made and told apart by Spark. They are sent to the executors in blocks of a fixed size, whatever the
length of single items; a benchmark of more than one block takes one scan of the documents for each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple
from uuid import uuid4

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from palimpsest.llm.columns import carried, restored
from palimpsest.storage import materialise

WINDOW = 10
#: (window, item) pairs of one automaton: ten nodes each at most, some 100 MB, of which an executor has one a worker.
BLOCK = 100_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SPAN = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(SPAN)), ("text_key", pa.binary())])


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``window`` (words joined by spaces) and ``item`` (its id as string), each pair once. A null item_id is the empty string."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return items.select("item", "words", F.explode(starts).alias("at")).select(F.array_join(F.slice("words", F.col("at"), F.lit(size)), " ").alias("window"), "item").distinct()


class Patterns:
    """The automaton of one block, made in each worker when first used, from its broadcast pairs."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.numbers: dict[bytes, int] = {}
        held: dict[tuple[int, ...], list[str]] = {}
        for window, item in pairs:
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window.encode().split(b" "))
            held.setdefault(key, []).append(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, items in held.items():
            self.automaton.add_word(key, (len(key), items))
        if held:
            self.automaton.make_automaton()

    def scan(self, lower: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The number of words, the stretches of words that are hit (end exclusive, apart), and the items that hit them."""
        words = WORD.findall(lower)
        known = self.numbers.get
        items: set[str] = set()
        stretches: list[tuple[int, int]] = []
        if not self.numbers or not words:
            return len(words), stretches, items
        for end, (length, own) in self.automaton.iter(tuple([known(w, 0) for w in words])):
            start, end = end - length + 1, end + 1
            items.update(own)
            # Ends rise; a longer window may begin before the stretches found last.
            while stretches and stretches[-1][1] >= start:
                start = min(start, stretches.pop()[0])
            stretches.append((start, end))
        return len(words), stretches, items


def _places(raw: bytes, stretches: list[tuple[int, int]]) -> list[dict]:
    """Stretches of words with their code points in the original text, ends exclusive."""
    bounds = {k for start, end in stretches for k in (start, end - 1)}
    at = {k: m.span() for k, m in enumerate(WORD.finditer(raw.lower())) if k in bounds} if bounds else {}
    found, passed, points = [], 0, 0
    for start, end in stretches:
        (a, _), (_, b) = at[start], at[end - 1]
        first = points + len(raw[passed:a].decode())
        passed, points = b, first + len(raw[a:b].decode())
        found.append({"first_word": start, "end_word": end, "start": first, "end": points})
    return found


class Block(NamedTuple):
    """A block of windows as sent to the executors, and a name for it."""

    name: str
    pairs: Broadcast


_cached: dict[str, Patterns] = {}


def _patterns(block: Block) -> Patterns:
    """A worker keeps the automaton of the block it used last."""
    if block.name not in _cached:
        _cached.clear()
        _cached[block.name] = Patterns(block.pairs.value)
    return _cached[block.name]


def _scanned(docs: DataFrame, block: Block, keyed: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = None
        for batch in batches:
            patterns = patterns or _patterns(block)
            columns: list[list] = [[] for _ in FOUND]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                raw = text.as_py() or b""
                n_words, stretches, items = patterns.scan(raw.lower())
                row = (doc_id, n_words, sorted(items), _places(raw, stretches), hashlib.sha256(raw).digest() if keyed else None)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, from_arrow_schema(FOUND))


def _merged(parts: list[DataFrame]) -> DataFrame:
    """What the blocks found in each row. Equal (doc_id, text) have equal findings, so these are merged once and then repeated."""
    span = from_arrow_schema(FOUND)["spans"].dataType

    @F.pandas_udf(span)
    def joined(found: pd.Series) -> pd.Series:
        return found.map(lambda spans: _joined([s if isinstance(s, dict) else s.asDict() for s in spans]))

    rows = reduce(DataFrame.unionByName, parts)
    found = rows.groupBy("doc_id", "text_key").agg(F.first("n_words").alias("n_words"), F.collect_set(F.struct("items", "spans")).alias("found"), F.count(F.lit(1)).alias("n"))
    copies = F.sequence(F.lit(1), (F.col("n") / len(parts)).cast("int"))
    once = found.select("doc_id", "n_words", F.array_sort(F.array_distinct(F.flatten("found.items"))).alias("items"), joined(F.array_sort(F.flatten("found.spans"))).alias("spans"), copies.alias("copies"))
    return once.select("doc_id", "n_words", "items", "spans", F.explode("copies")).drop("col")


def _joined(spans: list[dict]) -> list[dict]:
    """Spans in order of their first words; those that overlap or touch become one."""
    done: list[dict] = []
    for s in spans:
        if done and s["first_word"] <= done[-1]["end_word"]:
            done[-1] = done[-1] | {k: max(done[-1][k], s[k]) for k in ("end_word", "end")}
        else:
            done.append(s)
    return done


def blocks(benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> Iterator[list[tuple[str, str]]]:
    """The windows of a benchmark, in blocks of about ``block`` pairs each; one empty block if there are none."""
    pairs = materialise(windows(benchmark, size), "windows")
    n = max(1, -(-pairs.count() // block))
    numbered = pairs.withColumn("_block", F.pmod(F.xxhash64("window", "item"), F.lit(n)))
    for k in range(n):  # one bounded block at a time
        yield [tuple(r) for r in numbered.where(F.col("_block") == k).select("window", "item").collect()]


def _sent(docs: DataFrame, benchmark: DataFrame, size: int, block: int) -> list[Block]:
    return [Block(uuid4().hex, docs.sparkSession.sparkContext.broadcast(pairs)) for pairs in blocks(benchmark, size, block)]


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_words, items, spans`` of every row of ``docs``.

    ``spans`` are the stretches that windows cover, in order and apart: words ``first_word`` to ``end_word`` and code
    points ``start`` to ``end`` of the original text, from 0, ends exclusive. ``items`` are the sorted ids of the items whose windows
    occur. Null and empty texts have no words; null and repeated doc_ids are rows like any other. Items without words have
    no window; a null item_id is the empty string; a window of several items counts for each. Without documents
    there are no rows, without items no hits. Other columns are ignored.
    """
    sent = _sent(docs, benchmark, size, block)
    if len(sent) == 1:
        return _scanned(docs, sent[0], keyed=False).drop("text_key")
    return _merged([materialise(_scanned(docs, one, keyed=True), "leaks") for one in sent])


def without_leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns; nulls and empties as in ``leaks``."""
    rows = docs.select("text", carried(docs))
    for k, one in enumerate(_sent(docs, benchmark, size, block)):
        if k:
            rows = materialise(rows, "decontaminated")

        def run(batches: Iterator[pa.RecordBatch], one: Block = one) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                patterns, texts = _patterns(one), batch["text"].cast(pa.binary())
                yield batch.filter(pa.array([not patterns.scan((t.as_py() or b"").lower())[1] for t in texts], pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
    return restored(rows, docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans``, one row per row of ``docs``; see ``leaks``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    found = leaks(docs, benchmark).withColumn("n_hit", n_hit)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")


SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[p:p + 9], ' ') AS key FROM iw, range(1, greatest(len(w) - 8, 2)) r(p) WHERE len(w) > 0),
d AS (SELECT k, p, n, array_to_string(w[p:p + n - 1], ' ') AS key FROM dw, (SELECT DISTINCT n FROM i), unnest(range(1, len(w) - n + 2)) r(p)),
h AS (SELECT DISTINCT k, p, d.n, item FROM d JOIN i ON i.key = d.key AND i.n = d.n),
n AS (SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS x FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (k) LEFT JOIN t USING (k)
"""
