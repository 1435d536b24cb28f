"""Exact token counts from a histogram of encoded lengths.

Documents are encoded once and aggregated by encoded length.  The histogram, a few
thousand rows whatever the corpus, answers every later question by suffix sums: the
total, any quantile of the length, and the tokens kept under any context limit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices
from .piece_encoder import PieceEncoder


def encoded_lengths(docs: DataFrame, vocabulary_path: str, *, key: str = "doc_id", text: str = "text", extra_tokens: int = 0) -> DataFrame:
    """(key, n_tokens) of every whole text, in one pass without a shuffle; a key called n_tokens is called key.

    A null or empty text has extra_tokens only.  Keys may be of any type, null, or repeated: every row has its own length.
    An empty table gives none.  Other columns are not read.
    """
    name = "key" if key.lower() == "n_tokens" else key

    def lengths(batches):
        encoder = PieceEncoder.shared(vocabulary_path)
        for batch in slices(batches):
            got = [len(x) // 4 + extra_tokens for x in encoder.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], names=[name, "n_tokens"])

    rows = docs.select(F.col(key), F.col(text))
    return rows.mapInArrow(lengths, f"`{name}` {rows.schema[0].dataType.simpleString()}, n_tokens long")


def length_histogram(lengths: DataFrame, *, n_tokens: str = "n_tokens") -> DataFrame:
    """One row for each length that occurs, with sums over all documents at least and at most that long.

    n_tokens, n_docs; docs_at_least, tokens_at_least (suffix sums); docs_at_most;
    truncated_total: tokens left if every document is cut to n_tokens;
    total_docs, total_tokens.  An empty table gives no row.
    """
    counts = lengths.groupBy(F.col(n_tokens).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    # The window has one row for each distinct length; texts that differ in length by a token make one row more.
    longer = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_docs") * F.col("n_tokens")
    return (
        counts.withColumns({"docs_at_least": F.sum("n_docs").over(longer), "tokens_at_least": F.sum(tokens).over(longer), "total_docs": F.sum("n_docs").over(every), "total_tokens": F.sum(tokens).over(every)})
        .withColumn("docs_at_most", F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs"))
        .withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens"))
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_cut, kept_tokens) for each limit, which need not be a length that occurs."""
    limit = F.explode(F.lit([int(x) for x in limits]).cast("array<bigint>")).alias("context_limit")
    above = F.col("n_tokens") > F.col("context_limit")
    return (
        histogram.select("n_tokens", "n_docs", limit)
        .groupBy("context_limit")
        .agg(F.sum(F.when(above, F.col("n_docs")).otherwise(0)).alias("docs_cut"), F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("kept_tokens"))
    )


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents does not exceed."""
    share = F.explode(F.lit([float(x) for x in shares])).alias("share")
    reached = F.col("docs_at_most") >= F.ceil(F.col("share") * F.col("total_docs"))
    return histogram.select("n_tokens", "docs_at_most", "total_docs", share).where(reached).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
