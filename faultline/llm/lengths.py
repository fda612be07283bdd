"""Exact token counts: one histogram of encoded lengths answers totals, quantiles and truncated totals for every limit."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from faultline.llm import common, tokens
from faultline.session import cut_lineage

CHUNK = 1024


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(length, docs)``: documents by the number of ids of their whole text; null texts have none.

    Repeated rows count again, other columns are not read, an empty table gives an empty histogram.
    """
    path = path or tokens.default_path()

    @F.pandas_udf("long")
    def length(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x) // 4 for x in tokens.encoder(path).encode(texts.tolist())], dtype="int64")

    common.small_batches(docs.sparkSession)
    return docs.groupBy(length(F.coalesce("text", F.lit(""))).alias("length")).agg(F.count("*").alias("docs"))


def report(counts: DataFrame) -> DataFrame:
    """For each length that occurs, taken as the context limit: ``context_limit, docs, docs_within, docs_longer, tokens_within,
    tokens_longer, truncated_total, total_tokens, quantile``.

    ``truncated_total`` is what remains if every document is cut at the limit; ``quantile`` is the share of documents within
    it. Suffix sums run over chunks of the histogram and then inside each.
    """
    h = counts.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.floor(-F.col("length") / CHUNK).alias("chunk"), (-F.col("length")).alias("down"))
    h = cut_lineage(h)
    all_docs, all_tokens = h.agg(F.sum("docs"), F.sum("tokens")).first()
    h = common.running_total(h, [], "chunk", ["down"], "docs", "docs_longer")
    h = common.running_total(h, [], "chunk", ["down"], "tokens", "tokens_longer")
    within = F.lit(all_docs) - F.col("docs_longer")
    return h.select(F.col("length").alias("context_limit"), "docs", within.alias("docs_within"), "docs_longer",
                    (F.lit(all_tokens) - F.col("tokens_longer")).alias("tokens_within"), "tokens_longer",
                    (F.lit(all_tokens) - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_total"),
                    F.lit(all_tokens).cast("long").alias("total_tokens"), (within / F.lit(all_docs)).alias("quantile"))


def truncated_totals(counts: DataFrame, limits: list[int]) -> DataFrame:
    """``(context_limit, total)`` for any limits: what remains of all documents cut there."""
    asked = F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context_limit")
    return counts.select("length", "docs", asked).groupBy("context_limit").agg(F.sum(F.least("length", "context_limit") * F.col("docs")).alias("total"))


def quantiles(reported: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, length)``: the smallest length that at least this share of the documents does not exceed."""
    asked = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    return (reported.select("context_limit", "quantile", asked).where("quantile >= share")
            .groupBy("share").agg(F.min("context_limit").alias("length")))
