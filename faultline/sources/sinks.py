"""Writers: dated snapshots that are never rewritten, run metadata, append-only archive, resumable batches."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.session import cut_lineage

from faultline.sources.tables import fingerprint, path_exists


def write_snapshot(df: DataFrame, path: str) -> list[str]:
    """Append the evaluation dates that are not written yet; a written date never changes. Returns the new dates."""
    spark = df.sparkSession
    have = set()
    if path_exists(spark, path):
        have = {str(r[0]) for r in spark.read.parquet(path).select("as_of").distinct().collect()}      # one value per snapshot
    asked = [str(r[0]) for r in df.select("as_of").distinct().collect()]
    new = sorted(set(asked) - have)
    if new:
        df.where(F.col("as_of").cast("string").isin(new)).write.mode("append").partitionBy("as_of").parquet(path)
    return new


def write_export(frames: list[DataFrame], path: str) -> None:
    """CSV export with the union of all columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_run_meta(spark: SparkSession, path: str, as_of: str, version: str, weights: dict[str, float], period: str, signals: str) -> None:
    row = spark.createDataFrame([(as_of, version, weights, period, signals)], "as_of string, version string, weights map<string,double>, period string, signals string")
    row.withColumn("generated_at", F.current_timestamp()).write.mode("append").parquet(path)


def append_archive(df: DataFrame, path: str, key: list[str]) -> int:
    """Append rows with new keys; refuse the whole write when a known key comes with different content.

    The rows are computed once and stored, then checked, then moved.
    """
    spark = df.sparkSession
    rows = cut_lineage(fingerprint(df))
    if path_exists(spark, path):
        old = spark.read.parquet(path)
        clash = rows.join(old.select(*key, F.col("sha256").alias("_old")), key).where(F.col("sha256") != F.col("_old"))
        if not clash.isEmpty():
            raise ValueError("archive holds different content for an existing key")
        rows = rows.join(old.select(*key), key, "left_anti")
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def pending(inputs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Inputs whose output does not exist yet."""
    return inputs.join(done.select(*key).distinct(), key, "left_anti")


def resume(inputs: DataFrame, done: DataFrame, key: list[str], work) -> DataFrame:
    """Finished rows carried over plus ``work`` applied to the rest."""
    return done.join(inputs.select(*key), key, "left_semi").unionByName(work(pending(inputs, done, key)), allowMissingColumns=True)
