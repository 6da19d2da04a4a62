"""Language identification by prediction by partial matching.

For each language a tree of byte contexts, up to ``order`` bytes long, holds how
often each next byte followed. The statistics are frozen after training. The code
length of a text is the sum over its bytes of -log2 of the probability in the longest
known context, with an escape (method C: as likely as there are distinct next bytes) for
each context where the byte never followed; below the empty context all bytes are
equally likely. The language with the shortest code wins.

Code lengths are exact table look-ups: for every byte string of ``order + 1`` bytes that
any language saw, the cost of its last byte after the others is computed once for all
languages; other strings pay the escape of their context and go one order down.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 4
#: The classifier is fitted on at most so many different texts of each language, taken by their hash, on
#: at most so many bytes of each, and on at most so many languages (more are an error).
SAMPLE_DOCS = 400
SAMPLE_BYTES = 1 << 14
MAX_LANGUAGES = 64
UNKNOWN = "und"
#: The score is that of so many bytes at the text's average code lengths; the whole of a long text would always score 1.
SCORE_BYTES = 64
#: Bytes scored at a time.
BLOCK = 1 << 22


class Level(NamedTuple):
    """Strings of one length, as sorted integers; a row of ``cost`` has bits by language."""

    grams: np.ndarray
    cost: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray


class Model(NamedTuple):
    languages: list[str]
    order: int
    levels: list[Level]


def grams(data: np.ndarray, length: int) -> np.ndarray:
    """Each stretch of ``length`` bytes, ending at bytes ``length - 1`` and after, as an integer."""
    count = len(data) - length + 1
    if count <= 0:
        return np.empty(0, dtype=np.int64)
    found = np.zeros(count, dtype=np.int64)
    for i in range(length):
        found = found << 8 | data[i : i + count]
    return found


def train(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """Frozen statistics of each language's texts."""
    languages = sorted(texts)
    data = {x: [np.frombuffer(t.encode(), dtype=np.uint8).astype(np.int64) for t in texts[x]] for x in languages}
    levels: list[Level] = []
    below = np.full(len(languages), 8.0)
    for k in range(order + 1):
        counted = {x: np.unique(np.concatenate([np.empty(0, np.int64), *(grams(d, k + 1) for d in data[x])]), return_counts=True) for x in languages}
        known = np.unique(np.concatenate([v for v, _ in counted.values()])) if languages else np.empty(0, np.int64)
        contexts = np.unique(known >> 8)
        escape = np.zeros((len(contexts), len(languages)))
        cost = np.zeros((len(known), len(languages)))
        # A string that a language lacks pays the escape of its context and the cost one order down.
        lower = _lookup(levels, known & ((1 << 8 * k) - 1), len(known), below) if k else np.tile(below, (len(known), 1))
        for j, x in enumerate(languages):
            values, counts = counted[x]
            own, at = np.unique(values >> 8, return_inverse=True)
            total, kinds = np.bincount(at, counts, len(own)), np.bincount(at, minlength=len(own))
            escape[np.searchsorted(contexts, own), j] = np.log2((total + kinds) / kinds)
            cost[:, j] = escape[np.searchsorted(contexts, known >> 8), j] + lower[:, j]
            cost[np.searchsorted(known, values), j] = np.log2((total + kinds)[at] / counts)
        levels.append(Level(known, cost.astype(np.float32), contexts, escape.astype(np.float32)))
    return Model(languages, order, levels)


def _find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``values``, and which are real."""
    if not len(values):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


def _lookup(levels: list[Level], strings: np.ndarray, count: int, below: np.ndarray) -> np.ndarray:
    """Bits, by language, of the last byte of each string after the bytes before it."""
    level, bits = levels[-1], np.zeros((count, len(below)))
    at, real = _find(level.grams, strings)
    bits[real] = level.cost[at[real]]
    if len(rest := np.flatnonzero(~real)):
        context, seen = _find(level.contexts, strings[rest] >> 8)
        bits[rest[seen]] = level.escape[context[seen]]
        k = len(levels) - 1
        bits[rest] += _lookup(levels[:-1], strings[rest] & ((1 << 8 * k) - 1), len(rest), below) if k else below
    return bits


def code_lengths(model: Model, text: str) -> np.ndarray:
    """Bits of the whole text under each language."""
    data = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.int64)
    below, total = np.full(len(model.languages), 8.0), np.zeros(len(model.languages))
    for k in range(min(model.order, len(data))):  # the first bytes have shorter contexts
        total += _lookup(model.levels[: k + 1], grams(data[: k + 1], k + 1), 1, below).sum(axis=0)
    for start in range(0, max(0, len(data) - model.order), BLOCK):
        strings = grams(data[start : start + BLOCK + model.order], model.order + 1)
        values, counts = np.unique(strings, return_counts=True)
        total += counts @ _lookup(model.levels, values, len(values), below)
    return total


def sample(docs: DataFrame, limit: int = SAMPLE_DOCS, max_bytes: int = SAMPLE_BYTES, max_languages: int = MAX_LANGUAGES) -> dict[str, list[str]]:
    """Training texts by language, in bounded number; which ones depends on the texts alone.

    How many different texts a language has fixes a threshold on a hash of the text, so that about
    twice ``limit`` pass it; the ``limit`` smallest hashes of those are taken. Of a text longer than ``max_bytes`` a
    stretch of that many bytes is taken from a place that its hash gives, anywhere in the whole text. More than ``max_languages`` languages are an error, none is left out.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("hash"))
    counted = usable.select("lang", "hash").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1)
    sizes = {r["lang"]: r["n"] for r in counted.collect()}
    if not sizes:
        return {}
    if len(sizes) > max_languages:
        raise ValueError(f"the table has more than {max_languages} languages; the model is bounded by max_languages")
    span, factor = 1 << 40, 2
    start = F.pmod("hash", F.greatest(F.length("text") - max_bytes, F.lit(0)).cast("long") + 1).cast("int") + 1
    keyed = usable.select("lang", F.substr("text", start, F.lit(max_bytes)).alias("text"), F.pmod("hash", F.lit(span)).alias("share"))
    while True:
        bound = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(span, span * factor * limit // n))])
        passed = keyed.where(F.col("share") < F.element_at(bound, F.col("lang")))
        texts: dict[str, list[tuple[int, str]]] = {}
        for r in passed.distinct().toLocalIterator():  # at most about factor * limit * max_languages rows
            texts.setdefault(r["lang"], []).append((r["share"], r["text"]))
        if all(len(texts.get(lang, ())) >= min(limit, n) for lang, n in sizes.items()) or factor * limit >= max(sizes.values()):
            break
        factor *= 4
    return {lang: [t.encode()[:max_bytes].decode(errors="ignore") for _, t in sorted(found)[:limit]] for lang, found in texts.items()}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row.

    The score is the winner's share of 2**-bits over all languages, for the text or, if it is longer, for ``SCORE_BYTES``
    bytes at its average code lengths. Null and
    empty texts, and those without a letter, get ``und`` and score 0, as do all
    texts if nothing could be learnt; equal code lengths go to the first
    language in alphabetical order; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch["text"]:
                if not text.is_valid or not model.languages:
                    names.append(UNKNOWN), scores.append(0.0)
                    continue
                source = text.as_py()
                bits = code_lengths(model, source)
                best, share = int(np.argmin(bits)), min(1.0, SCORE_BYTES / len(source.encode()))
                names.append(model.languages[best]), scores.append(float(1 / np.exp2(np.maximum(share * (bits[best] - bits), -1000)).sum()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def held_out() -> Column:
    """Rows kept from training: the CRC-32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, order: int = ORDER, limit: int = SAMPLE_DOCS, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """Train on the rows that are not held out and predict all: ``doc_id, held_out, lang_pred, score``."""
    model = train(sample(docs.where(~held_out()), limit, max_languages=max_languages), order)
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
