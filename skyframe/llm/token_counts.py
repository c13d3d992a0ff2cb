"""Exact length histogram: totals, quantiles and truncated totals for every context limit.

Documents are encoded once; their lengths are counted with map-side partial
sums, so what moves is a row per length and task.  Suffix sums over the
histogram then answer every question about a context limit.  They are taken in
two levels (blocks of ``SPAN`` lengths, then lengths within a block), so no
window holds more than a block or the list of blocks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import default_tokenizer, encoder, text_slices, tokenizer_json

SPAN = 4096


def _lengths(json):
    def lengths(batches):
        own = encoder(json.value)
        for batch in batches:
            for _, texts in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(own.lengths(texts))], names=["n_tokens"])

    return lengths


def token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens): the encoded length of each row's whole text, no special tokens added; 0 for null and empty texts."""
    json = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer or default_tokenizer()))
    return docs.select("text").mapInArrow(_lengths(json), "n_tokens long")


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many rows have each encoded length. Empty for an empty table."""
    return token_lengths(docs, tokenizer).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """What each context limit costs: a row per length that occurs, as ``limit``.

    n_docs: documents of just that length; docs_over and tokens_over: documents
    longer than the limit and all their tokens; truncated_tokens: tokens that
    stay if every document is cut to the limit; lost_tokens: tokens that go;
    quantile: share of documents within the limit.  Between two rows every
    column is constant but the token columns, which are linear in the limit
    (slope docs_over), so the rows answer every limit: see ``at_limits``.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / SPAN)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("toks"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("toks").over(after), F.lit(0)).alias("toks_after"),
        F.sum("docs").over(everything).alias("all_docs"),
        F.sum("toks").over(everything).alias("all_tokens"),
    )
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(blocks, "block")
    out = out.withColumn("docs_over", F.col("docs_after") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0)))
    out = out.withColumn("tokens_over", F.col("toks_after") + F.coalesce(F.sum("tokens").over(longer), F.lit(0)))
    out = out.withColumn("lost_tokens", F.col("tokens_over") - F.col("docs_over") * F.col("n_tokens"))
    return out.select(
        F.col("n_tokens").alias("limit"),
        "n_docs",
        "docs_over",
        "tokens_over",
        (F.col("all_tokens") - F.col("lost_tokens")).alias("truncated_tokens"),
        "lost_tokens",
        "all_docs",
        "all_tokens",
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_over, truncated_tokens) for given limits, in one aggregation of the histogram."""
    sums = []
    for at in limits:
        sums += [F.sum(F.when(F.col("n_tokens") > at, F.col("n_docs")).otherwise(0)), F.sum(F.least("n_tokens", F.lit(at)) * F.col("n_docs"))]
    one = histogram.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)])
    rows = [F.struct(F.lit(at).cast("long").alias("limit"), F.coalesce(f"c{2 * i}", F.lit(0)).alias("docs_over"), F.coalesce(f"c{2 * i + 1}", F.lit(0)).alias("truncated_tokens")) for i, at in enumerate(limits)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def quantile_lengths(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents doesn't exceed."""
    rows = context_limits(histogram)
    parts = [F.min(F.when(F.col("quantile") >= s, F.col("limit"))).alias(f"q{i}") for i, s in enumerate(shares)]
    one = rows.agg(*parts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])).alias("r")).select("r.*")
