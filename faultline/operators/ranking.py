"""Peer scores and positions."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.operators.ordering import positions, with_positions


def peer_scores(long: DataFrame, by: list[str], value: str = "value", direction: str = "direction") -> DataFrame:
    """0 (strongest) .. 100 (weakest) within a peer group, half credit for ties, null groups of one dropped.

    ``long`` has one row per company and metric; ``by`` names the peer group and the metric.
    """
    signed = long.withColumn("_v", F.col(direction) * F.col(value))
    placed = with_positions(signed.where(F.col("_v").isNotNull()), by, "_v", descending=True)
    raw = 100 * (1 - (F.col("before") + (F.col("ties") - 1) / F.lit(2.0)) / (F.col("n") - 1))
    return (placed.where(F.col("n") >= 2)
            .withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))
            .withColumn("rank", F.col("before") + 1).drop("_v", "before", "ties"))


def outsider_scores(outsiders: DataFrame, reference: DataFrame, by: list[str], value: str = "value",
                    direction: str = "direction") -> DataFrame:
    """Outsiders placed in the distribution of a reference population that they do not change.

    Outsider values enter the position count with weight 0, so one pass ranks both.
    """
    ref = reference.select(*by, (F.col(direction) * F.col(value)).alias("_v"), F.lit(1).alias("_w"))
    out = outsiders.withColumn("_v", F.col(direction) * F.col(value)).where(F.col("_v").isNotNull())
    both = ref.unionByName(out.select(*by, "_v", F.lit(0).alias("_w")))
    placed = out.join(positions(both, by, "_v", descending=True, weight=F.col("_w")), [*by, "_v"])
    raw = 100 * (1 - (F.col("before") + F.col("ties") / F.lit(2.0)) / F.col("n"))
    return (placed.where(F.col("n") >= 2)
            .withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))
            .withColumn("rank", F.col("before") + 1).drop("_v", "before", "ties"))
