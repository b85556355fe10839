"""Exact length histogram: documents are aggregated by encoded length once; suffix sums over it answer every context limit.

Defined results: a null or empty text has length 0 and is counted; repeated rows count each; an empty table gives no
rows; extra columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, text_of, texts_as_bytes, written
from .encode import encoder

#: Lengths that share a block of the two-step running sums.
BLOCK = 1024


def lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, n_docs) counted per stretch of rows, a partial aggregate on the map side."""

    def kernel(batches):
        enc = encoder(vocabulary)
        for batch in small_batches(batches, 2048):
            n = np.fromiter((len(x) // 4 for x in enc.encode(texts_as_bytes(batch.column(0)))), np.int64, batch.num_rows)
            values, counts = np.unique(n, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], ["n_tokens", "n_docs"])

    return docs.select(text_of().alias("text")).mapInArrow(kernel, "n_tokens long, n_docs long")


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """From (n_tokens, n_docs): for each length L also docs_longer and tokens_longer (documents of over L tokens),
    docs_up_to, truncated_total (the corpus's tokens when texts are cut at L), dropped_tokens (those lost by it) and
    quantile (the share of documents of at most L tokens). Sums run over blocks of lengths, then inside each block."""
    total = histogram.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    total = total.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = total.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"), F.sum("d").over(every).alias("docs_all"), F.sum("t").over(every).alias("tokens_all"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = total.join(blocks, "block")
    out = out.withColumn("docs_longer", F.col("d_later") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("tokens_longer", F.col("t_later") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    up_to = F.col("docs_all") - F.col("docs_longer")
    kept = F.col("tokens_all") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")
    return out.select("n_tokens", "n_docs", "docs_longer", "tokens_longer", up_to.alias("docs_up_to"), kept.alias("truncated_total"), (F.col("tokens_all") - kept).alias("dropped_tokens"), (up_to / F.col("docs_all")).alias("quantile"))


def token_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Texts are encoded once: both readers of the histogram get it from a written table of a row a length."""
    counted = lengths(docs, vocabulary).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    return with_suffix_sums(written(counted, "lengths"))


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """One row (total): tokens left when every text is cut at any `limit`, from the histogram alone."""
    return table.agg(F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("total"))


def length_quantile(table: DataFrame, q: float) -> DataFrame:
    """One row (n_tokens): the least length that at least a share q of documents do not exceed; null for no documents."""
    return table.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
