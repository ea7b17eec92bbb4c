"""Token counts from the exact histogram of encoded lengths.

Documents are encoded whole and only their lengths leave the tasks. Per length, the suffix sums of documents and tokens
answer, for a context limit L, how many documents are longer, and how many tokens stand if all are cut at L:
sum(min(n, L)) = tokens of documents below L + L * documents of L or more. The sums have two levels (blocks of lengths, then
lengths), so no task gathers all lengths of a source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import stored
from .encoder import encoder

#: Lengths of a block of the suffix sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, tokenizer: str, *, text_col: str = "text", by: str | None = None) -> DataFrame:
    """(by, n_tokens, n) counts of encoded lengths, without special tokens; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for b in batches:
            n = np.fromiter((code.count(t.as_py()) for t in b.column(1)), dtype=np.int64, count=b.num_rows)
            counts = pa.Table.from_arrays([b.column(0), pa.array(n)], names=["by", "n_tokens"]).group_by(["by", "n_tokens"]).aggregate([([], "count_all")])
            yield from counts.rename_columns(["by", "n_tokens", "n"]).combine_chunks().to_batches()

    key = F.lit(None).cast("string") if by is None else F.col(by).cast("string")
    rows = docs.select(key.alias("by"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "by string, n_tokens bigint, n bigint").groupBy("by", "n_tokens").agg(F.sum("n").alias("n"))


def length_histogram(docs: DataFrame, tokenizer: str, *, text_col: str = "text", by: str | None = None) -> DataFrame:
    """A row for each length that occurs (of each value of by, null too): n_tokens, n_docs, docs_at_least and
    tokens_at_least (suffix sums), docs_total, tokens_total, tokens_cut (tokens that stand with this length as the limit)
    and share_at_most (of the documents: its rank among quantiles). An empty table gives no rows.
    """
    lengths = stored(encoded_lengths(docs, tokenizer, text_col=text_col, by=by), "lengths").withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    lengths = lengths.withColumn("t", F.col("n") * F.col("n_tokens"))
    within = Window.partitionBy("by", "block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    blocks = lengths.groupBy("by", "block").agg(F.sum("n").alias("bn"), F.sum("t").alias("bt"))
    above = Window.partitionBy("by").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("by")
    blocks = blocks.select(F.col("by").alias("by2"), F.col("block").alias("block2"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"), F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("at"), F.sum("bn").over(every).alias("docs_total"), F.sum("bt").over(every).alias("tokens_total"))
    out = lengths.join(blocks, F.col("by").eqNullSafe(F.col("by2")) & (F.col("block") == F.col("block2")))
    out = out.withColumn("docs_at_least", F.sum("n").over(within) + F.col("an")).withColumn("tokens_at_least", F.sum("t").over(within) + F.col("at"))
    cut = F.col("tokens_total") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")
    at_most = (F.col("docs_total") - F.col("docs_at_least") + F.col("n")) / F.col("docs_total")
    return out.select(F.col("by").alias(by or "by"), "n_tokens", F.col("n").alias("n_docs"), "docs_at_least", "tokens_at_least", "docs_total", "tokens_total", cut.alias("tokens_cut"), at_most.alias("share_at_most"))


def cut_totals(histogram: DataFrame, limits: Sequence[int], by: str = "by") -> DataFrame:
    """For each limit (any number, whether or not a document has that length): limit, tokens_cut, docs_longer."""
    grid = F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in limits])).alias("limit")
    n, limit = F.col("n_tokens"), F.col("limit")
    rows = histogram.select(by, "n_tokens", "n_docs", grid)
    return rows.groupBy(by, "limit").agg(F.sum(F.least(n, limit) * F.col("n_docs")).alias("tokens_cut"), F.sum(F.when(n > limit, F.col("n_docs")).otherwise(0)).alias("docs_longer"))


def length_quantiles(histogram: DataFrame, shares: Sequence[float], by: str = "by") -> DataFrame:
    """The least length that at least a share of the documents do not exceed: share, n_tokens."""
    grid = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    return histogram.select(by, "n_tokens", "share_at_most", grid).where(F.col("share_at_most") >= F.col("share")).groupBy(by, "share").agg(F.min("n_tokens").alias("n_tokens"))
