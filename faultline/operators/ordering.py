"""Exact ranks, row numbers and order statistics over groups of any size.

A plain ``rank() over (partition by g order by v)`` sorts a whole group in one task. Here the group is cut
into value buckets: rows are first collapsed to (group, value, count), ranked inside (group, bucket) and
shifted by the number of rows in the buckets before. The bucket of a value is a fixed monotone function,
so nothing is sampled and a recomputed task gives the same answer. At most about 40,000 buckets exist per
group, whatever its row count.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

STEPS_PER_OCTAVE = 256
SMALLEST = 2.0 ** 20          # values below 2**-20 share the first bucket


def order_bucket(value: Column) -> Column:
    """Monotone integer bucket of a number (or of a date, by day)."""
    x = value.cast("double")
    return (F.signum(x) * F.floor(F.log2(F.abs(x) * F.lit(SMALLEST) + 1) * STEPS_PER_OCTAVE)).cast("int")


def positions(df: DataFrame, by: list[str], value: str, descending: bool = False,
              weight: Column | None = None) -> DataFrame:
    """One row per (group, distinct value): ``before`` rows strictly ahead, ``ties`` equal rows, ``n`` all rows."""
    def direction(c):
        return F.col(c).desc() if descending else F.col(c).asc()

    counts = (df.where(F.col(value).isNotNull()).groupBy(*by, value)
              .agg((F.sum(weight) if weight is not None else F.count("*")).alias("ties"))
              .withColumn("_b", order_bucket(F.col(value))))
    group = W.partitionBy(*by)
    buckets = (counts.groupBy(*by, "_b").agg(F.sum("ties").alias("_bn"))
               .withColumn("_ahead", F.coalesce(F.sum("_bn").over(
                   group.orderBy(direction("_b")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("n", F.sum("_bn").over(group)).drop("_bn"))
    inside = W.partitionBy(*by, "_b").orderBy(direction(value)).rowsBetween(W.unboundedPreceding, -1)
    return (counts.join(buckets, [*by, "_b"])
            .withColumn("before", F.col("_ahead") + F.coalesce(F.sum("ties").over(inside), F.lit(0)))
            .drop("_b", "_ahead"))


def with_positions(df: DataFrame, by: list[str], value: str, descending: bool = False) -> DataFrame:
    """The rows of ``df`` with ``before``, ``ties`` and ``n``; rows without a value get nulls."""
    return df.join(positions(df, by, value, descending), [*by, value], "left")


def with_average_rank(df: DataFrame, by: list[str], value: str, out: str, descending: bool = False) -> DataFrame:
    """Tie-averaged 1-based rank."""
    return (with_positions(df, by, value, descending)
            .withColumn(out, F.col("before") + (F.col("ties") + 1) / F.lit(2.0)).drop("before", "ties"))


def with_row_number(df: DataFrame, by: list[str], value: str, tie: str, out: str = "pos",
                    descending: bool = False, tie_bucket: Column | None = None) -> DataFrame:
    """1-based row number ordered by (value, tie ascending), exact for groups and ties of any size.

    ``tie_bucket`` must be monotone in ``tie``; the default is for numbers, ``text_bucket`` is for text.
    """
    bucket = order_bucket(F.col(tie)) if tie_bucket is None else tie_bucket
    ranked = with_positions(df, by, value, descending).withColumn("_tb", bucket)
    keys = [*by, value]
    ahead = (ranked.groupBy(*keys, "_tb").agg(F.count("*").alias("_c"))
             .withColumn("_skip", F.coalesce(F.sum("_c").over(
                 W.partitionBy(*keys).orderBy("_tb").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c"))
    inside = W.partitionBy(*keys, "_tb").orderBy(tie)
    return (ranked.join(ahead, [*keys, "_tb"])
            .withColumn(out, F.col("before") + F.col("_skip") + F.row_number().over(inside))
            .drop("before", "ties", "_tb", "_skip"))


def text_bucket(c: Column, chars: int = 6) -> Column:
    """The leading characters sort like the whole text."""
    return F.substring(c, 1, chars)


def order_statistics(df: DataFrame, by: list[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """Values at 0-based ascending positions; each pick is a column expression over the group size ``n``."""
    pos = positions(df, by, value)
    aggs = [F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("ties")), F.col(value))).alias(name)
            for name, k in picks.items()]
    return pos.groupBy(*by).agg(*aggs, F.max("n").alias("n"))


def medians(df: DataFrame, by: list[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group, mean of the two middle values when the count is even."""
    n = F.col("n")
    lo, hi = F.floor((n - 1) / 2), F.floor(n / 2)
    return (order_statistics(df, by, value, {"_lo": lo, "_hi": hi})
            .select(*by, ((F.col("_lo") + F.col("_hi")) / 2).alias(out), "n"))
