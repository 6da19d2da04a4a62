"""Token counts from an exact length histogram.

Documents are encoded once and aggregated by their number of tokens. What any context
limit costs follows from sums over that histogram: with L tokens of context, the
documents shorter than L count in full and each other one counts L.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.byte_bpe import WHITE, byte_pair_encoder, load_ranks
from palimpsest.storage import materialise

#: Texts encoded together.
GROUP = 256
#: Lengths whose sums are added up in one task; then the blocks' sums are.
BLOCK = 4096
#: White space that long overflows the stack of the tokenizer library; such texts go through operator 4's encoder.
LONG_WHITE = 4096


@cache
def counter(rank_file: str, pattern: str) -> Callable[[str], int]:
    """How many tokens a text has; one function for all tasks of a Python worker."""
    import tiktoken

    encode = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=load_ranks(rank_file), special_tokens={}).encode_ordinary
    long_white = re.compile(rf"[{WHITE}]{{{LONG_WHITE}}}").search

    def count(text: str) -> int:
        if long_white(text):
            return len(byte_pair_encoder(rank_file, pattern).encode_bytes(text)) // 4
        return len(encode(text))

    return count


def lengths(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens`` of every whole text; null text has none."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(rank_file, pattern)
        for batch in (b.slice(i, GROUP) for b in batches for i in range(0, b.num_rows, GROUP)):
            counts = pa.array([count(text) for text in batch["text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], counts], names=["doc_id", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """``n_tokens, n_docs``: how many rows have each length; rows are combined within tasks first."""
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(lengths_of: DataFrame) -> DataFrame:
    """The histogram with what it answers for each of its lengths as a context limit.

    ``docs_from, tokens_from``: documents of that length or more, and their tokens;
    ``truncated_tokens``: tokens of all documents cut to it; ``share_to``: the share of
    documents that are no longer, so the quantile of q is the first length with
    ``share_to >= q``; ``total_docs, total_tokens``. An empty histogram has no rows.
    """
    rows = lengths_of.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    # One task adds up the blocks: one row for every 4096 lengths, whatever the number of documents.
    later = W.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("docs"), F.sum("_tokens").alias("tokens"))  # a row per 4096 lengths
    blocks = blocks.select(
        "_block", F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("_docs_later"), F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("_tokens_later"),
        F.sum("docs").over(everything).alias("total_docs"), F.sum("tokens").over(everything).alias("total_tokens"),
    )
    down = W.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = rows.join(blocks, "_block").select(
        "n_tokens", "n_docs", (F.sum("n_docs").over(down) + F.col("_docs_later")).alias("docs_from"), (F.sum("_tokens").over(down) + F.col("_tokens_later")).alias("tokens_from"), "total_docs", "total_tokens"
    )
    truncated = F.col("total_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
    share = 1 - (F.col("docs_from") - F.col("n_docs")) / F.col("total_docs")
    return summed.select("n_tokens", "n_docs", "docs_from", "tokens_from", truncated.alias("truncated_tokens"), share.alias("share_to"), "total_docs", "total_tokens")


def truncated_totals(lengths_of: DataFrame, limits: Sequence[int]) -> dict[int, int]:
    """Tokens of all documents cut to each limit, whether or not a document has that length; one pass over the histogram."""
    if not limits:
        return {}
    sums = [F.coalesce(F.sum(F.least("n_tokens", F.lit(x)) * F.col("n_docs")), F.lit(0)).alias(str(i)) for i, x in enumerate(limits)]
    return dict(zip(limits, lengths_of.agg(*sums).first(), strict=True))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> dict[float, int | None]:
    """For each share, the smallest length that so many documents don't exceed; null if there are none."""
    if not shares:
        return {}
    firsts = [F.min(F.when(F.col("total_docs") - F.col("docs_from") + F.col("n_docs") >= F.lit(x) * F.col("total_docs"), F.col("n_tokens"))).alias(str(i)) for i, x in enumerate(shares)]
    return dict(zip(shares, sums.agg(*firsts).first(), strict=True))


def count_tokens(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """The length histogram of all rows of ``docs`` with its suffix sums.

    Null and empty texts have length 0; null and repeated doc_ids count like any other; an
    empty table gives an empty result; other columns are ignored.
    """
    return suffix_sums(materialise(histogram(lengths(docs, rank_file, pattern)), "lengths"))
