"""Token counts by an exact length histogram: suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outing.llm.common import batches_of, cut, map_pandas, table
from outing.llm.tokens import encoder, tokenizer_path

#: Lengths that one window of the suffix sums covers; the blocks' own sums are a table this many times smaller.
BLOCK = 4096


def lengths(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, tokens) of every whole text; null and empty texts have 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for pdf in batches_of(batches, 256):
            got = encode.ids([t or "" for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(x) // 4 for x in got]})

    return map_pandas(docs.select("doc_id", "text"), count, "doc_id long, tokens long")


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(tokens, n_docs): how many documents have each encoded length."""
    return lengths(docs, path or tokenizer_path()).groupBy("tokens").agg(F.count("*").alias("n_docs"))


def for_every_limit(hist: DataFrame) -> DataFrame:
    """One row for each length that occurs, as a context limit; between two of them the counts don't change.

    context_limit, n_docs (of just that length), docs_within, docs_over, tokens_within (in documents within the
    limit), tokens_truncated (if every document is cut to the limit), tokens_lost, share_within (docs_within of all).
    """
    hist = hist.withColumn("block", F.floor(F.col("tokens") / BLOCK).cast("long"))
    volume = F.col("tokens") * F.col("n_docs")
    later = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)  # a row for each BLOCK lengths
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("n"), F.sum(volume).alias("v"))
    blocks = blocks.select(
        F.col("block").alias("of"),
        F.coalesce(F.sum("n").over(later), F.lit(0)).alias("n_after"),
        F.coalesce(F.sum("v").over(later), F.lit(0)).alias("v_after"),
    )
    totals = hist.agg(F.sum("n_docs").alias("n_all"), F.sum(volume).alias("v_all"))
    above = Window.partitionBy("block").orderBy("tokens").rowsBetween(1, Window.unboundedFollowing)
    return (
        hist.withColumn("n_above", F.coalesce(F.sum("n_docs").over(above), F.lit(0)))
        .withColumn("v_above", F.coalesce(F.sum(volume).over(above), F.lit(0)))
        .join(blocks, F.col("block") == F.col("of"))
        .join(F.broadcast(totals))  # one row
        .withColumn("docs_over", F.col("n_above") + F.col("n_after"))
        .withColumn("v_over", F.col("v_above") + F.col("v_after"))
        .withColumn("tokens_within", F.col("v_all") - F.col("v_over"))
        .withColumn("tokens_truncated", F.col("tokens_within") + F.col("tokens") * F.col("docs_over"))
        .select(
            F.col("tokens").alias("context_limit"),
            "n_docs",
            (F.col("n_all") - F.col("docs_over")).alias("docs_within"),
            "docs_over",
            "tokens_within",
            "tokens_truncated",
            (F.col("v_all") - F.col("tokens_truncated")).alias("tokens_lost"),
            ((F.col("n_all") - F.col("docs_over")) / F.col("n_all")).alias("share_within"),
        )
    )


def at_limit(table: DataFrame, limit: int) -> DataFrame:
    """The answers of for_every_limit at any `limit`: from the largest length at or below it, carried on to it."""
    last = table.filter(F.col("context_limit") <= limit).orderBy(F.desc("context_limit")).limit(1)
    more = (limit - F.col("context_limit")) * F.col("docs_over")
    return last.select(
        F.lit(limit).cast("long").alias("context_limit"),
        "docs_within",
        "docs_over",
        "tokens_within",
        (F.col("tokens_truncated") + more).alias("tokens_truncated"),
        (F.col("tokens_lost") - more).alias("tokens_lost"),
        "share_within",
    )


def quantile(table: DataFrame, share: float) -> DataFrame:
    """The least length that `share` of all documents don't exceed."""
    return table.filter(F.col("share_within") >= share).agg(F.min("context_limit").alias("tokens"))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """for_every_limit of `docs` (doc_id, text; other columns are not read).

    Null and empty texts count as documents of 0 tokens, repeated rows once each; an empty table gives no rows.
    """
    return for_every_limit(cut(histogram(docs, path)))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, quantiles and truncated totals of all documents for every context limit."""
    return token_counts(table(spark, sf_dir, "documents"))
