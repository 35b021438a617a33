"""Token counts: an exact histogram of encoded lengths answers totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks
from .shared import bounded_batches, materialize

#: Lengths in one block of the suffix sums.
BLOCK = 512


def encoded_lengths(df: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """n_tokens long of each row's whole text; null and empty texts have 0. One row per input row, in no order."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunks.byte_bpe(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in encode([x or "" for x in batch.column(0).to_pylist()])], pa.int64())], names=["n_tokens"])
        encode.rest()

    return df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(df: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """n_tokens, n_docs: one row per encoded length that occurs. An empty table has none."""
    return encoded_lengths(df, tokenizer_path, text).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def length_report(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit, from suffix sums of the histogram:

    n_tokens (the limit), n_docs (documents of just this length), docs_at_least, tokens_at_least, docs_longer, tokens_within (of
    documents no longer than the limit), truncated_total (all documents cut to the limit), lost_tokens, quantile (share of documents no
    longer), total_docs, total_tokens. Limits that don't occur are answered by the next lower row plus docs_longer for each token more.

    The sums run inside blocks of lengths, and over one row per block: no task sees all rows. The histogram is read twice and should
    be a table. Rows with null lengths or counts are left out; repeated lengths are added up.
    """
    clean = histogram.where(F.col("n_tokens").isNotNull() & F.col("n_docs").isNotNull()).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    rows = clean.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    weight = F.col("n_tokens") * F.col("n_docs")
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum(weight).alias("block_tokens"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("tokens_above"),
        F.sum("block_docs").over(whole).alias("total_docs"),
        F.sum("block_tokens").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    sums = rows.withColumns({"docs_here": F.sum("n_docs").over(inside), "tokens_here": F.sum(weight).over(inside)}).join(blocks, "block")
    docs, tokens = F.col("docs_here") + F.col("docs_above"), F.col("tokens_here") + F.col("tokens_above")
    longer, within = docs - F.col("n_docs"), F.col("total_tokens") - tokens + weight
    truncated = within + longer * F.col("n_tokens")
    return sums.select(
        "n_tokens",
        "n_docs",
        docs.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        longer.alias("docs_longer"),
        within.alias("tokens_within"),
        truncated.alias("truncated_total"),
        (F.col("total_tokens") - truncated).alias("lost_tokens"),
        (1 - longer / F.col("total_docs")).alias("quantile"),
        "total_docs",
        "total_tokens",
    )


def truncated_totals(report: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, truncated_total for any limits, in one pass: each takes the row of the longest length no longer than itself."""
    row = F.struct("n_tokens", "truncated_total", "docs_longer")
    found = report.agg(F.max("total_docs").alias("n"), *[F.max(F.when(F.col("n_tokens") <= x, row)).alias(f"r{i}") for i, x in enumerate(limits)])
    answers = []
    for i, x in enumerate(limits):
        r = F.col(f"r{i}")
        total = F.when(r.isNull(), F.coalesce("n", F.lit(0)) * x).otherwise(r["truncated_total"] + r["docs_longer"] * (x - r["n_tokens"]))
        answers.append(F.struct(F.lit(x).cast("long").alias("context_limit"), total.alias("truncated_total")))
    return found.select(F.inline(F.array(*answers)))


def length_quantiles(report: DataFrame, levels: list[float]) -> DataFrame:
    """level, n_tokens for any levels from 0 to 1, in one pass: the least length that at least this share of the documents doesn't exceed. Null if
    there are no documents."""
    docs = F.col("total_docs") - F.col("docs_longer")
    found = report.agg(*[F.min(F.when(docs >= F.greatest(F.ceil(F.lit(x) * F.col("total_docs")), F.lit(1)), F.col("n_tokens"))).alias(f"q{i}") for i, x in enumerate(levels)])
    return found.select(F.inline(F.array(*[F.struct(F.lit(float(x)).alias("level"), F.col(f"q{i}").alias("n_tokens")) for i, x in enumerate(levels)])))


def op3(df: DataFrame, tokenizer_path: str) -> DataFrame:
    return length_report(materialize(length_histogram(df, tokenizer_path), "lengths"))
