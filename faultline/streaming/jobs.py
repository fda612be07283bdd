"""The incremental jobs as Structured Streaming queries over a file source."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline import rules
from faultline.functions.text import credit_event
from faultline.operators.stats import collapse_repeats


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Files as they arrive; ``files_per_batch`` bounds a batch."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(folder)


def intake(stream: DataFrame, key: list[str], time: str, delay: str = "30 days") -> DataFrame:
    """New documents since the last check, each id once."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def detect_credit_events(titles: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """titles: code, date, title → events with severity and validity; rejected reviews are left out."""
    kind = F.when(F.contains("title", F.lit("可能被实施")), "st_warning").otherwise(credit_event(F.col("title")))
    base = credit_event(F.col("title"))
    t = titles.withColumn("event_type", F.when(base.isNotNull() & ~F.contains("title", F.lit("参股")), kind)).where("event_type is not null")
    if reviewed is not None:
        t = (t.join(reviewed.select("code", "date", "title", "include"), ["code", "date", "title"], "left")
             .where("include is null or include <> 'N' or event_type = 'st_warning'").drop("include"))
    severity = F.when((F.col("event_type") == "st_warning") | F.contains("title", F.lit("子公司")), "medium").otherwise("high")
    return t.withColumn("severity", severity).withColumn("valid_to", F.date_add("date", rules.CREDIT_EVENT_DAYS))


def collapse_sink(path: str, key: list[str], date: str = "date", every: int = 8) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink for ``read_collapsed``: the days of each key, each once. What is kept is decided when the table is
    read, so days may arrive in any order and in any batch; a key's days are bounded by the calendar."""
    return upsert_latest(path, [*key, date], date, every)


def read_collapsed(spark: SparkSession, path: str, key: list[str], date: str = "date", days: int = rules.COLLAPSE_DAYS) -> DataFrame:
    """Events more than ``days`` after the last kept one of the key, over all batches so far."""
    return collapse_repeats(read_latest(spark, path, [*key, date], date), key, date, days)


def tumbling_counts(stream: DataFrame, time: str, size: str, by: list[str], delay: str = "1 day", slide: str | None = None) -> DataFrame:
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return (stream.withWatermark(time, delay).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("start"), *by, "n"))


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], delay: str = "1 day") -> DataFrame:
    return (stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n"))


def _written(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers n of the folders ``kind=n`` that a sink has finished."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}=*/_SUCCESS")
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def upsert_latest(path: str, key: list[str], version: str, every: int = 8) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: each batch writes its newest row per key as one more increment; ``read_latest`` folds them.

    A batch that is run again overwrites its own increment. Every ``every`` batches the increments are folded into a
    snapshot and removed, so a reader meets one snapshot and a few increments however long the stream has run.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bases = _written(spark, path, "base")
        if bases and epoch <= bases[-1]:
            return                                                   # a batch run again after its snapshot
        rest = [c for c in batch.columns if c not in [*key, version]]
        newest = batch.groupBy(*key).agg(F.max(F.struct(F.col(version).alias("_v"), *rest)).alias("_r")).select(*key, "_r.*")
        newest = newest.drop("_v") if version in key else newest.withColumnRenamed("_v", version)
        newest.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        if (epoch + 1) % every == 0:
            read_latest(spark, path, key, version).write.mode("overwrite").parquet(f"{path}/base={epoch}")
            for e in _written(spark, path, "epoch"):
                _remove(spark, f"{path}/epoch={e}")
            for b in bases:
                _remove(spark, f"{path}/base={b}")
    return sink


def read_latest(spark: SparkSession, path: str, key: list[str], version: str) -> DataFrame:
    """Latest state per key from the newest snapshot and the increments after it."""
    base = _written(spark, path, "base")[-1:]
    parts = [f"{path}/base={b}" for b in base] + [f"{path}/epoch={e}" for e in _written(spark, path, "epoch") if not base or e > base[0]]
    t = spark.read.parquet(*parts)
    rest = [c for c in t.columns if c not in [*key, version]]
    folded = t.groupBy(*key).agg(F.max(F.struct(F.col(version).alias("_v"), *rest)).alias("_r")).select(*key, "_r.*")
    return folded.drop("_v") if version in key else folded.withColumnRenamed("_v", version)


def retrying(work: Callable[[DataFrame], DataFrame], out: str, dead: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: rows that failed before are tried again with the new batch.

    ``work`` gets a column ``attempt`` (0 at first) and returns the rows with a boolean ``ok``. Failures go to the
    dead-letter table of the epoch; ``drain`` tries those of the last one.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        todo = batch.withColumn("attempt", F.lit(0))
        before = [e for e in _written(spark, dead, "epoch") if e < epoch]
        if before:
            todo = todo.unionByName(spark.read.schema(todo.schema).parquet(f"{dead}/epoch={before[-1]}"))
        done = work(todo)
        done.where("ok").drop("ok").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        done.where("not ok").select(*todo.columns).withColumn("attempt", F.col("attempt") + 1).write.mode("overwrite").parquet(f"{dead}/epoch={epoch}")
    return sink


def drain(spark: SparkSession, work: Callable[[DataFrame], DataFrame], out: str, dead: str, attempts: int = 3) -> DataFrame:
    """Try what the last batch left, at most ``attempts`` times; returns the rows that still fail."""
    step = retrying(work, out, dead)
    for _ in range(attempts):
        last = _written(spark, dead, "epoch")[-1]
        left = spark.read.parquet(f"{dead}/epoch={last}")
        if left.isEmpty():
            break
        step(left.drop("attempt").limit(0), last + 1)
    return spark.read.parquet(f"{dead}/epoch={_written(spark, dead, 'epoch')[-1]}")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available, then return the written table."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    q = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
