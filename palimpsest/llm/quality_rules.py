"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a DataFrame expression over the whole text: no user function, no
shuffle, no explode. ``RULES`` is a plain table (measure, lowest, highest); ``verdict``
folds it into one boolean column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.columns import ROW, carried, restored

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words by language. Texts that ``lang`` says are in another one, or in none, aren't judged by them.
STOP_WORDS = {
    "en": "the of and to a in is it that for on with as by this be at are was from or an not he his but they have you had",
    "fr": "de la le et les des en un du une que est dans qui pour par sur au avec il ne se pas plus ce sont elle",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha",
}
ALL_STOP_WORDS = tuple(sorted({w for words in STOP_WORDS.values() for w in words.split()}))

#: Measure, lowest and highest value that passes; None: no bound. The first two are the base rules.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, None),
    ("repeat_word_ratio", None, 0.30),
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_ratio", None, 0.07),
    ("stop_word_ratio", 0.06, None),
    ("dup_line_ratio", None, 0.50),
    ("letter_ratio", 0.50, None),
    ("echo_ratio", None, 0.20),
)
BASE_MEASURES = ("n_words", "repeat_word_ratio")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more, first ones included.

    Windows are compared by XXH64 over the XXH64 of their words.
    """

    def keys(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (window - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, window)))

    def positions(found: Column) -> Column:
        return let(
            F.array_sort(F.transform(found, lambda key, i: F.struct(key.alias("key"), i.alias("at")))),
            lambda order: F.array_sort(
                F.filter(
                    F.transform(
                        order,
                        lambda x, i: F.when(
                            x["key"].eqNullSafe(F.get(order, i - 1)["key"]) | x["key"].eqNullSafe(F.get(order, i + 1)["key"]), x["at"]
                        ),
                    ),
                    lambda at: at.isNotNull(),
                )
            ),
        )

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - at, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    counted = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hashes: let(
            keys(hashes), lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(let(positions(found), covered))
        ),
    )
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(counted)


def measured(docs: DataFrame, text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Counts of every text, beside ``extra`` columns of ``docs``; null text has none of anything.

    ``n_stop_words`` is null where the language has no list.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    listed = F.col("lang").isin(*STOP_WORDS) if "lang" in docs.columns else F.lit(False)
    worded = docs.select(*extra, value.alias("_text"), words_of(value).alias("_words"), listed.alias("_listed"))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.length(without(line, SPACES)) > 0)
    bare = F.transform("_words", lambda w: F.lower(F.btrim(w, F.lit(".,;:!?()\"'"))))
    return worded.select(
        *extra,
        # The partition's number keeps a filter on these counts above them: pushed below, it would repeat all the work.
        F.when(F.spark_partition_id() >= 0, F.size("_words")).cast("long").alias("n_words"),
        F.length(without(F.col("_text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("_listed"), F.size(F.filter(bare, lambda w: w.isin(*ALL_STOP_WORDS)))).cast("long").alias("n_stop_words"),
        F.length(F.regexp_replace("_text", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.size(F.filter("_words", lambda w, i: w == F.get("_words", i - 1))).cast("long").alias("n_echoes"),
    )


def ratios() -> dict[str, Column]:
    """Measures that the rules name, from the counts; null where nothing can be divided."""
    share = lambda part, whole: F.try_divide(F.col(part), F.col(whole))
    return {
        "n_words": F.col("n_words"),
        "repeat_word_ratio": share("n_repeat_words", "n_words"),
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "word_chars"),
        "stop_word_ratio": share("n_stop_words", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "letter_ratio": share("n_letters", "word_chars"),
        "echo_ratio": share("n_echoes", "n_words"),
    }


def verdict(rules=RULES) -> Column:
    """True where every rule passes; a measure that doesn't exist passes."""
    known, passed = ratios(), F.lit(True)
    for name, lowest, highest in rules:
        if lowest is not None:
            passed = passed & F.coalesce(known[name] >= lowest, F.lit(True))
        if highest is not None:
            passed = passed & F.coalesce(known[name] <= highest, F.lit(True))
    return passed


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """Counts and verdict of every row of ``docs``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_lines, n_stop_words, n_letters,
    n_echoes`` (words equal to the word before). Null
    and empty texts have no words and fail; null doc_ids and repeated rows are
    judged like any other; an empty table gives an empty result. Of other columns
    only ``lang`` counts, if there is one.
    """
    counts = measured(docs, extra=("doc_id",))
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"), "n_lines", "n_stop_words", "n_letters", "n_echoes",
    )


def drop_rejected(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    known = [c for c in ("text", "lang") if c in docs.columns]
    counts = measured(docs.select(carried(docs), *known), extra=(ROW,))
    return restored(counts.where(~base_failed() & verdict(rules)), docs.columns)


def sql(rules=RULES) -> str:
    """DuckDB SQL for ``quality`` over ``documents``."""
    spaces = r"[\x20\x09-\x0D]"
    stops, languages = (", ".join(f"'{w}'" for w in words) for words in (ALL_STOP_WORDS, STOP_WORDS))
    ratio = {
        "n_words": "n_words", "repeat_word_ratio": "n_repeat_words / nullif(n_words, 0)", "mean_word_chars": "word_chars / nullif(n_words, 0)",
        "symbol_ratio": "n_symbols / nullif(word_chars, 0)", "stop_word_ratio": "n_stop_words / nullif(n_words, 0)",
        "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)", "letter_ratio": "n_letters / nullif(word_chars, 0)", "echo_ratio": "n_echoes / nullif(n_words, 0)",
    }
    tests = [f"coalesce({ratio[n]} >= {low}, true)" for n, low, _ in rules if low is not None]
    tests += [f"coalesce({ratio[n]} <= {high}, true)" for n, _, high in rules if high is not None]
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT id, doc_id, lang, t, list_filter(regexp_split_to_array(t, '{spaces}+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), win AS (
  SELECT id, pos, array_to_string(list_slice(words, pos, pos + {WINDOW - 1}), ' ') AS key
  FROM (SELECT id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS pos FROM w)
), again AS (
  SELECT id, pos FROM win QUALIFY count(*) OVER (PARTITION BY id, key) > 1
), covered AS (
  SELECT id, count(DISTINCT pos + k) AS n FROM again, range(0, {WINDOW}) AS r(k) GROUP BY id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{spaces}+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, CASE WHEN lang IN ({languages}) THEN len(list_filter(words, lambda x: lower(trim(x, '.,;:!?()"''')) IN ({stops}))) END::BIGINT AS n_stop_words,
         length(regexp_replace(t, '\P{{L}}+', '', 'g'))::BIGINT AS n_letters,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))::BIGINT AS n_echoes
  FROM w LEFT JOIN covered USING (id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(tests)} AS kept, n_lines, n_stop_words, n_letters, n_echoes
FROM b
"""
