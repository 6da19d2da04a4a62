"""Personal data by bootstrapped contextual extraction.

1. *Seeds*: strict patterns find e-mail addresses, IP addresses, card and phone numbers.
2. *Instances*: looser shapes find strings that could be such data; seeds are instances too.
3. *Patterns*: for each kind that an instance could be, the two words in front of it, the words on both sides,
   the word in front, the word behind, and its own form (digits as zeros, with what its check digit says).
4. *Scores*: Spark goes back and forth over the pattern-instance graph. A pattern's
   confidence is the share of its distinct instances that are certain, with one uncertain one added; the less a
   pattern says, the more certain instances it needs. Patterns below ``CONFIDENCE`` say nothing; an
   instance's score is that not all of its other patterns are wrong.
5. Instances that score high enough are added to the seeds, wherever they stand, and make
   patterns more certain in the next round.

Only instances and edges of the graph are shuffled, never texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.columns import ROW, carried, restored
from palimpsest.storage import materialise

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
ROUNDS = 3
#: Distinct certain instances that a pattern needs, by what it is made of.
SUPPORT = {"before": 5, "around": 5, "word": 20, "after": 20, "form": 20}
#: Confidence from which a pattern counts, and score from which an instance is found.
CONFIDENCE = 0.9
#: Words of patterns that are longer are replaced by their hash.
LONG_WORD = 40
#: Groups of digits that a window over a long run of numbers has at most (a phone number's parts).
WINDOW = 6
#: Texts scanned together.
GROUP = 256
#: Tables of patterns, values and rows are sent to all executors up to so many rows; beyond, they are joined by shuffle.
BROADCAST_ROWS = 100_000

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
#: A match can only begin where a run of digits does, since it takes whole runs.
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_numeric = re.compile(r"[0-9][0-9()./ -]*").finditer
_groups = re.compile(r"[0-9()./-]+").finditer
_dotted = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\.) ?[0-9]{1,3}){3}(?![0-9A-Za-z])", re.I).finditer
_colons = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])").finditer
_digits = re.compile(r"[0-9]")
_words = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_").finditer
_at = re.compile(r"\[at\]|\(at\)", re.I)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := _domain(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns, by kind, then start; code points, end exclusive."""
    found = [(EMAIL, a, b) for a, b in _emails(text)]
    found += [(IP, *m.span()) for m in _ip(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
    for m in _card(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((CARD, *m.span()))
    found += [(PHONE, *m.span()) for m in _phone(text) if 8 <= len(_digits.findall(m[0])) <= 15]
    return found


def _address_like(text: str) -> Iterator[tuple[int, int]]:
    """White-space-delimited strings with an at sign, plain or bracketed."""
    for mark in ("@", "[at]", "(at)"):
        last, at = 0, text.find(mark)
        while at >= 0:
            start, end = at, at + len(mark)
            while start > last and not text[start - 1].isspace():
                start -= 1
            while end < len(text) and not text[end].isspace():
                end += 1
            if start < at and end > at + len(mark):
                yield start, end - len(text[at:end]) + len(text[at:end].rstrip(".,;:!?)>\"'"))
            last = end
            at = text.find(mark, end)


def _windows(text: str, run: re.Match) -> Iterator[tuple[int, int, int]]:
    """Numbers inside a run that is too long to be one: a phone number behind a plus, and groups whose check digit is right."""
    groups = [m.span() for m in _groups(text, run.start(), run.end())]
    counts = [len(_digits.findall(text, a, b)) for a, b in groups]
    for i in range(len(groups)):
        digits = 0
        for j in range(i, min(i + WINDOW, len(groups))):
            digits += counts[j]
            if digits > 19:
                break
            start, end = groups[i][0], groups[j][1]
            if i == 0 and text[start - 1 : start] == "+" and 8 <= digits <= 15:
                yield PHONE, start - 1, end
            elif digits >= 16 and luhn("".join(_digits.findall(text, start, end))):
                yield CARD, start, end


def loose_spans(text: str, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of strings that could be of a kind and touch no seed; one string may have two kinds."""
    found = [(EMAIL, a, b) for a, b in _address_like(text)]
    found += [(IP, *m.span()) for pattern in (_dotted, _colons) for m in pattern(text) if len(m[0]) > 6]
    for m in _numeric(text):
        whole = m[0].rstrip("()./ -")
        n = len(_digits.findall(whole))
        start, end = m.start(), m.start() + len(whole)
        if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
            continue
        if 7 <= n <= 15:
            found.append((PHONE, start, end))
        if 12 <= n <= 19:
            found.append((CARD, start, end))
        if n > 15:
            found += _windows(text, m)
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in seeds):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    free = [x for x in found if bisect_right(ends, x[1]) == bisect_left(starts, x[2])] if starts else found
    return sorted(set(free))


def value_of(kind: int, found: str) -> str:
    """What instances are compared by: digits alone, or the address in lower case with plain separators."""
    if kind == EMAIL:
        return _at.sub("@", found.lower())
    if kind == IP:
        return found.lower() if ":" in found else ".".join(str(int(x)) for x in re.findall("[0-9]+", found))
    return "".join(_digits.findall(found))


def form_of(kind: int, found: str) -> str:
    """How an instance is written: the domain of an e-mail address, an IP address whatever its dots look like, or digits as zeros and what the check digit says."""
    if kind == EMAIL:
        return _digits.sub("0", value_of(kind, found).partition("@")[2])
    if kind == IP:
        if ":" in found or " " in found:
            return re.sub("[0-9a-f]+", "0", found.lower())
        return "0.0.0.0" if all(int(x) <= 255 for x in value_of(kind, found).split(".")) else "over"
    form = _digits.sub("0", found)
    return f"{form} {luhn(value_of(kind, found))}" if kind == CARD else form


def _short(word: str) -> str:
    return word if len(word) <= LONG_WORD else "#" + xxhash.xxh64_hexdigest(word.encode("utf-8", "surrogatepass"))


def patterns_of(text: str, spans: list[tuple[int, int, int]]) -> list[list[str]]:
    """The patterns of each span. Words are runs of letters or digits, or one other character; ``^`` and ``$`` stand for what is missing at the ends."""
    if not spans:
        return []
    starts, ends = [], []
    for m in _words(text):
        starts.append(m.start()), ends.append(m.end())
    word = lambda i: "^" if i < 0 else "$" if i >= len(starts) else _short(text[starts[i] : ends[i]].lower())
    found = []
    for kind, start, end in spans:
        left, right = bisect_right(ends, start) - 1, bisect_left(starts, end)
        first, last, behind = word(left - 1), word(left), word(right)
        found.append([f"before {first} {last}", f"around {last} {behind}", f"word {last}", f"after {behind}", f"form {_short(form_of(kind, text[start:end]))}"])
    return found


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
INSTANCE = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])


def scanned(docs: DataFrame, carry: Column, held: bool = False) -> DataFrame:
    """``carry`` of every row, ``_row`` (a number of its own), ``_base`` spans and ``_instances``; ``held``: the text is a field of ``carry``."""
    rows = docs.select(carry.alias(ROW), F.monotonically_increasing_id().alias("_row"), *([] if held else [F.col("text").alias("_text")]))
    span = [T.StructField(name, T.IntegerType()) for name in ("kind", "start", "end")]
    instance = [*span, T.StructField("seed", T.BooleanType()), T.StructField("value", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))]
    schema = T.StructType(
        [*rows.schema.fields[:2], T.StructField("_base", T.ArrayType(T.StructType(span))), T.StructField("_instances", T.ArrayType(T.StructType(instance)))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, GROUP) for b in batches for i in range(0, b.num_rows, GROUP)):
            base, instances = [], []
            for text in (pc.struct_field(batch[ROW], "text") if held else batch["_text"]).to_pylist():
                text = text or ""
                seeds = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in seeds])
                spans = [*seeds, *loose_spans(text, seeds)]
                patterns = patterns_of(text, spans)
                instances.append(
                    [
                        {"kind": k, "start": a, "end": b, "seed": i < len(seeds), "value": value_of(k, text[a:b]), "patterns": patterns[i]}
                        for i, (k, a, b) in enumerate(spans)
                    ]
                )
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(base, pa.list_(SPAN)), pa.array(instances, pa.list_(INSTANCE))], names=[*batch.schema.names[:2], "_base", "_instances"])

    return rows.mapInArrow(run, schema)


def sent(df: DataFrame) -> DataFrame:
    """``df``, a written table, marked for broadcast if it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def scored(pairs: DataFrame, rounds: int = ROUNDS, support: dict[str, int] = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``kind, value, score`` of the instances found in the graph ``kind, pattern, value, seed`` (one row per edge), seeds included."""
    pairs = materialise(pairs, "pii-graph")
    seeds = pairs.groupBy("kind", "value").agg(F.max("seed").alias("seed"))
    sure = seeds.where("seed").select("kind", "value", F.lit(1.0).alias("score"))
    needed = F.element_at(F.create_map(*[F.lit(x) for item in support.items() for x in item]), F.substring_index("pattern", " ", 1))
    for _ in range(rounds):
        sure = materialise(sure, "pii-found")
        patterns = (
            pairs.select("kind", "pattern", "value")
            .join(sent(sure), ["kind", "value"], "left")
            .groupBy("kind", "pattern")
            .agg((F.coalesce(F.sum("score"), F.lit(0.0)) / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count("score").alias("certain"))
            .where((F.col("confidence") >= confidence) & (F.col("certain") >= needed))
            .select("kind", "pattern", F.log(1 - F.col("confidence")).alias("doubt"))
        )
        backed = pairs.join(sent(materialise(patterns, "pii-patterns")), ["kind", "pattern"]).groupBy("kind", "value").agg((1 - F.exp(F.sum("doubt"))).alias("score"), F.max("seed").alias("seed"))
        others = backed.where(~F.col("seed") & (F.col("score") >= confidence)).select("kind", "value", "score")
        sure = seeds.where("seed").select("kind", "value", F.lit(1.0).alias("score")).unionByName(others)
    return sure


def _apart(found: list) -> list[dict]:
    """Of spans that overlap, the one with the higher score stays, then the longer, then the first."""
    starts, kept = [], []
    for x in sorted(found, key=lambda x: (-x["score"], x["start"] - x["end"], x["start"], x["kind"])):
        at = bisect_right(starts, x["start"])
        if (at == 0 or kept[at - 1]["end"] <= x["start"]) and (at == len(kept) or kept[at]["start"] >= x["end"]):
            starts.insert(at, x["start"])
            kept.insert(at, {name: x[name] for name in ("kind", "start", "end")})
    return kept


def found_spans(docs: DataFrame, carry: Column, rounds: int = ROUNDS, support: dict[str, int] = SUPPORT, confidence: float = CONFIDENCE, held: bool = False) -> DataFrame:
    """``carry``, ``_base`` and ``_added``: arrays of (kind, start, end), for every row of ``docs``; ``held``: the text is a field of ``carry``."""
    rows = materialise(scanned(docs, carry, held), "pii")
    instances = rows.select("_row", F.inline("_instances"))
    pairs = instances.select("kind", "value", "seed", F.explode("patterns").alias("pattern")).groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"))
    sure = materialise(scored(pairs, rounds, support, confidence), "pii-found")

    @F.pandas_udf("array<struct<kind:int,start:int,end:int>>")
    def apart(spans: pd.Series) -> pd.Series:
        return pd.Series([_apart(found) for found in spans], dtype=object)

    found = instances.where(~F.col("seed")).join(sent(sure), ["kind", "value"])
    added = found.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end", "score")).alias("found")).select("_row", apart("found").alias("_added"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    joined = rows.drop("_instances").join(sent(materialise(added, "pii-added")), "_row", "left")
    return joined.select(ROW, "_base", F.coalesce("_added", none).alias("_added"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """Personal data of every row of ``docs``.

    ``doc_id, n_email, n_ip, n_card, n_phone`` (base spans of each kind),
    ``base_sha256, spans, n_added``. Spans that the method adds touch no base span and no other one. Null text
    counts as empty; repeated rows and null doc_ids are scanned each; an empty table gives an empty result; other
    columns are ignored.
    """
    found = found_spans(docs, F.col("doc_id"))
    counts = [_count(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)]
    return found.select(
        F.col(ROW).alias("doc_id"), *counts, F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("_base", "_added"))).alias("spans"), F.size("_added").cast("long").alias("n_added")
    )


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; spans that overlap become one, of the first kind."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; ``n_chars`` follows where there is such a column.

    Null texts and null n_chars stay null.
    """

    @F.pandas_udf(T.StringType())
    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if text is None else redacted(text, [(s["kind"], s["start"], s["end"]) for s in found]) for text, found in zip(texts, spans, strict=True)], dtype=object)

    found = found_spans(docs, carried(docs), held=True)
    spans, text = F.concat("_base", "_added"), F.col(f"{ROW}.text")
    cleaned = found.select(ROW, F.when(F.size(spans) == 0, text).otherwise(replaced(text, spans)).alias("_clean"))
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(f"{ROW}.n_chars").isNotNull(), F.length("_clean")).cast(docs.schema["n_chars"].dataType)
    return restored(cleaned, docs.columns, **new)
