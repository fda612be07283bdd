"""Helpers shared by the training-data operators: reading, numbering rows, running totals, components, samples."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from faultline.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
#: Documents handed to Python at a time; with very long texts a batch stays in the tens of MB.
BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the text that one Arrow batch brings into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (a projection may inline it into every use)."""
    return F.transform(F.array(value), body)[0]


def row_hash(row: str) -> Column:
    """A text that settles ties between rows, whatever the partitioning: a hash over all columns, which need not be orderable."""
    return F.sha2(F.to_json(row).cast("binary"), 256)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Number distinct rows from 0 by ``order``: range partitions, a number inside each, plus the rows of those before.

    Only one count for each range partition meets in a single task.
    """
    n = parallelism(df.sparkSession)
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return (ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part")      # a row for each partition
            .withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_part", "_inside", "_before"))


def running_total(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, name: str) -> DataFrame:
    """``name`` = sum of ``value`` in the rows before, within ``keys``, ordered by ``chunk`` and then ``order``.

    Sums of chunks are added up first, so that a group is spread over as many tasks as it has chunks. ``keys`` and
    ``chunk`` must not be null.
    """
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    upto = W.partitionBy(*keys).orderBy(chunk) if keys else W.orderBy(chunk)
    base = sums.select(*keys, chunk, (F.sum("_sum").over(upto) - F.col("_sum")).alias("_base"))
    inside = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (df.withColumn("_upto", F.sum(value).over(inside)).join(base, [*keys, chunk])
            .withColumn(name, F.col("_base") + F.col("_upto") - F.col(value)).drop("_upto", "_base"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``edges (a, b)``; root is the smallest node reachable.

    Alternating star contraction: each round hangs neighbours on the smallest node seen. Minima are aggregated before
    the shuffle and joined back, so a hub's neighbours are never gathered in one row. Each round is a written table.
    """
    stars = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())
        seen = mark
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        stars = cut_lineage(small.distinct(), instead_of=stars)


def labelled(labels: DataFrame, label: str, fold: int, held_out: int, bound: int) -> DataFrame:
    """``(doc_id, y)`` of at most ``bound`` labelled rows outside the held-out fold, chosen by hash of doc_id.

    The fold is crc32(doc_id as text) mod ``fold``. Rows without doc_id or label are left out; of several labels of one
    document the largest counts.
    """
    kept = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~in_fold(F.col("doc_id"), fold, held_out))
    return (kept.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))


def in_fold(doc_id: Column, fold: int, remainder: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % fold == remainder
