"""Text codecs and delta chains (CMP1-7 of the survey).

Plain codecs are Arrow UDFs on whole columns. A delta chain stores the first of
every 50 revisions of a page, and its last, in full, and the others as edits of the
revision before; chains are cut at the full ones. Sequences are made from keys without texts, and
texts meet by revision or by chain, so that a page with a huge history is coded in pieces by many tasks.

A stored revision names its ``chain``, by the id of the full revision it begins with, and its ``place`` in it, from 0. So a text
needs only the rows of its chain up to its own place.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.history import ORDER, PAGE_KEY, at_of, chronology, content_hash, crowded, distinct_revisions, sequenced
from palimpsest.schemas import KEY_FRAME_INTERVAL

LZMA_PRESET = 6
#: Compress and uncompress, by codec (CMP3); add pairs here to offer more.
CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "NONE": (bytes, bytes),
    "GZIP": (lambda x: gzip.compress(x, mtime=0), gzip.decompress),
    "BZIP2": (bz2.compress, bz2.decompress),
    "LZMA2": (lambda x: lzma.compress(x, preset=LZMA_PRESET), lzma.decompress),
}
DELTA = "DIFFBZIP2"
#: What differs up to this length is compared by character, which takes the square of it.
FINE_GAP = 64
#: Shorter stretches are inserted again, as that takes less than to say where they stand.
LEAST_COPY = 12
#: Pieces that a text is cut into, coarse to fine: lines, words, and stretches that end by their content, for scripts without spaces.
CUTS = (re.compile(r"[^\n]*\n|[^\n]+"), re.compile(r"\S*\s+|\S+"), re.compile(r"[^aeo、。的のは이]{0,63}.", re.DOTALL))
STORED = ("codec", "data", "base_id", "chain", "place")


def packed(text: str, codec: str) -> bytes:
    return CODECS[codec][0](text.encode())


def unpacked(data: bytes | None, codec: str | None) -> str | None:
    """Null for deltas, which need their chain, and for unknown codecs."""
    if data is None or codec not in CODECS:
        return None
    return CODECS[codec][1](bytes(data)).decode()


def compress(text: Column, codec: str) -> Column:
    """CMP1/CMP4: binary of the UTF-8 text; null stays null."""
    if codec not in CODECS:
        raise ValueError(f"no such codec: {codec}")

    @F.pandas_udf(T.BinaryType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else packed(x, codec))

    return run(text)


def uncompress(data: Column, codec: Column) -> Column:
    """CMP2."""

    @F.pandas_udf(T.StringType())
    def run(data: pd.Series, codecs: pd.Series) -> pd.Series:
        return pd.Series([unpacked(x, c) for x, c in zip(data, codecs, strict=True)], dtype=object)

    return run(data, codec)


def edits(old: str, new: str) -> bytes:
    """What turns ``old`` into ``new``: ranges of ``old`` to copy, and strings to insert.

    What both begin and end with is copied; between, texts are compared by those lines that
    occur once in each, so that many equal lines cost no time; what differs between lines is compared by words in the same way,
    then by shorter stretches, and what is short by character. So a changed word in a long line costs a word.
    """
    head = _common(old, new)
    tail = _common(old[head:][::-1], new[head:][::-1])
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    steps: list = [[0, head]] if head else []
    matched = [m for m in _matched(a, b, CUTS) if m[2] >= LEAST_COPY]
    at = 0
    for start, place, length in [*matched, (len(a), len(b), 0)]:
        if at < place:
            steps.append(b[at:place])
        if length:
            steps.append([head + start, head + start + length])
        at = place + length
    if tail:
        steps.append([len(old) - tail, len(old)])
    return bz2.compress(json.dumps(steps, ensure_ascii=False).encode())


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def _characters(a: str, b: str) -> list[tuple[int, int, int]]:
    return [(m.a, m.b, m.size) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


def _matched(a: str, b: str, cuts: tuple[re.Pattern, ...]) -> list[tuple[int, int, int]]:
    """Common stretches, by the coarsest pieces first; what lies between is matched by finer ones."""
    if not a or not b:
        return []
    if max(len(a), len(b)) <= FINE_GAP:
        return _characters(a, b)
    if not cuts:
        return []
    found, at, to = [], 0, 0
    for start, place, length in [*_pieces(cuts[0].findall(a), cuts[0].findall(b)), (len(a), len(b), 0)]:
        found += [(at + i, to + j, n) for i, j, n in _matched(a[at:start], b[to:place], cuts[1:])]
        if length:
            found.append((start, place, length))
        at, to = start + length, place + length
    return found


def _pieces(left: list[str], right: list[str]) -> list[tuple[int, int, int]]:
    """Common stretches (place in the first text, place in the second, length) around pieces that each has once, in the order of both."""
    once_left, once_right = Counter(left), Counter(right)
    where = {line: i for i, line in enumerate(left) if once_left[line] == 1}
    pairs = [(where[line], j) for j, line in enumerate(right) if once_right[line] == 1 and line in where]
    starts_left, starts_right = [0, *accumulate(map(len, left))], [0, *accumulate(map(len, right))]
    found, end_left, end_right = [], 0, 0
    for i, j in _rising(pairs):
        if i < end_left or j < end_right:
            continue
        low = 0
        while i - low > end_left and j - low > end_right and left[i - low - 1] == right[j - low - 1]:
            low += 1
        up = 1
        while i + up < len(left) and j + up < len(right) and left[i + up] == right[j + up]:
            up += 1
        start, place = starts_left[i - low], starts_right[j - low]
        found.append((start, place, starts_left[i + up] - start))
        end_left, end_right = i + up, j + up
    return found


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest sub-sequence of pairs whose first numbers rise."""
    tops, ends, before = [], [], []
    for k, (i, _) in enumerate(pairs):
        at = bisect_left(tops, i)
        before.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(i), ends.append(k)
        else:
            tops[at], ends[at] = i, k
    found, k = [], ends[-1] if ends else -1
    while k >= 0:
        found.append(pairs[k])
        k = before[k]
    return found[::-1]


def edited(old: str, delta: bytes) -> str:
    return "".join(x if isinstance(x, str) else old[x[0] : x[1]] for x in json.loads(bz2.decompress(delta)))


def frames(revisions: DataFrame, text: str, key=PAGE_KEY, interval: int = KEY_FRAME_INTERVAL, last_full: bool = True) -> DataFrame:
    """``key, _at, base, full, chain, place`` of every revision, once: ``base`` is the one before, which a delta is against, else null.

    Full are the first of every ``interval``, the last if ``last_full`` says so, and those behind one without a text. Rows have no texts; a chain
    is within an interval, so a page's intervals are tasks of their own.
    """
    start = F.col(text).isNull().alias("start")
    if crowded(revisions, key):
        narrow = sequenced(revisions.withColumn("start", start), key, ("start",))
        previous = F.struct(*[F.col(f"previous.{c}") for c in ORDER])
        placed = narrow.select(*key, *ORDER, "rn", "cnt", F.when(F.col("previous").isNotNull(), previous).alias("previous"), F.col("previous.start").alias("no_base"))
    else:
        order = chronology(key)
        narrow = revisions.groupBy(*key, *ORDER).agg(F.min_by(start, content_hash(revisions, key)).alias("start"))
        placed = narrow.select(
            *key, *ORDER, F.row_number().over(order).alias("rn"), F.count(F.lit(1)).over(W.partitionBy(*key)).alias("cnt"), F.lag(at_of()).over(order).alias("previous"), F.lag("start").over(order).alias("no_base")
        )
    full = ((F.col("rn") - 1) % interval == 0) | (F.lit(last_full) & (F.col("rn") == F.col("cnt"))) | F.coalesce("no_base", F.lit(True))
    block = W.partitionBy(*key, F.floor((F.col("rn") - 1) / interval)).orderBy("rn")
    begun = F.max(F.when(F.col("full"), F.struct("rn", "revision_id"))).over(block)
    found = placed.withColumn("full", full).withColumn("_begun", begun)
    return found.select(*key, at_of().alias("_at"), F.when(~F.col("full"), F.col("previous")).alias("base"), "full", F.col("_begun.revision_id").alias("chain"), (F.col("rn") - F.col("_begun.rn")).cast("int").alias("place"))


def compress_history(revisions: DataFrame, text: str = "text", key=PAGE_KEY, interval: int = KEY_FRAME_INTERVAL, last_full: bool = True) -> DataFrame:
    """CMP5: the revisions, each once, with ``codec``, ``data``, ``base_id`` (what a delta is against), ``chain`` and ``place`` in place of the text.

    Only keys are put in sequence; the text that a delta is against joins by its revision. Revisions without text have
    neither codec nor data, and the one behind them is stored in full.
    """
    once = distinct_revisions(revisions, key)
    rows = once.join(frames(revisions, text, key, interval, last_full), [*key, "_at"])
    bases = once.select(*key, F.col("_at").alias("base"), F.col(text).alias("_old"))
    paired = rows.where("base IS NOT NULL").join(bases, [*key, "base"]).unionByName(rows.where("base IS NULL").withColumn("_old", F.lit(None).cast("string")))

    @F.pandas_udf(T.BinaryType())
    def stored(full: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([None if n is None else packed(n, "BZIP2") if f else edits(o, n) for f, o, n in zip(full, old, new, strict=True)], dtype=object)

    codec = F.when(F.col(text).isNull(), F.lit(None)).when(F.col("full"), "BZIP2").otherwise(DELTA)
    kept = [c for c in revisions.columns if c != text]
    return paired.select(*kept, codec.alias("codec"), stored("full", "_old", text).alias("data"), F.when(codec == DELTA, F.col("base.revision_id")).alias("base_id"), "chain", "place")


def compress_rendered(revisions: DataFrame, key=PAGE_KEY, interval: int = KEY_FRAME_INTERVAL) -> DataFrame:
    """CMP7: revisions with rendered ``html``, stored as chains of their own: full is the first of every ``interval``, but not the last.

    Where rendering failed, ``html`` is null; ``html_error`` says so and nothing is stored.
    """
    return compress_history(revisions.withColumn("html_error", F.col("html").isNull()), "html", key, interval, last_full=False)


def decode_history(stored: DataFrame, text: str = "text", key=PAGE_KEY) -> DataFrame:
    """CMP6: the revisions with their text; ``text_error`` is true where a delta has lost its base.

    Chains are decoded one by one. Parts of a chain will do, if they begin with its first row.
    """
    names = [c for c in stored.columns if c not in STORED]
    schema = T.StructType([*[stored.schema[c] for c in names], T.StructField(text, T.StringType()), T.StructField("text_error", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, old, old_id = None, None, None
        for batch in batches:
            texts, errors = [], []
            for *at, own_id, codec, data, base_id in batch[[*key, "chain", "revision_id", "codec", "data", "base_id"]].itertuples(index=False):
                if at != chain:
                    chain, old = at, None
                lost = codec == DELTA and (old is None or base_id != old_id)
                old = None if lost else edited(old, bytes(data)) if codec == DELTA else unpacked(data, codec)
                old_id = own_id
                texts.append(old)
                errors.append(lost)
            out = batch[names].copy()
            out[text], out["text_error"] = texts, errors
            yield out[[f.name for f in schema.fields]]

    return stored.repartition(*key, "chain").sortWithinPartitions(*key, "chain", "place").mapInPandas(run, schema)
