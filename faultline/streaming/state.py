"""Keyed state that outlives the batches: the latest version of each key, forgotten after a quiet time."""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline.streaming.jobs import _written

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestVersion(StatefulProcessor):
    """Holds the newest row of a key by ``version``; a timer on the latest event time forgets the key.

    Emits a ``live`` row whenever the state may have changed, and an ``expired`` row when the timer fires.
    """

    def __init__(self, key: list[str], version: str, time: str, rest: list[str], quiet_ms: int, schema: T.StructType):
        self.key, self.version, self.time, self.rest, self.quiet_ms, self.schema = key, version, time, rest, quiet_ms, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", T.StructType([self.schema[c] for c in [self.version, *self.rest]] + [T.StructField("expires", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.latest.get() if self.latest.exists() else None
        newest, expires = (tuple(held[:-1]), held[-1]) if held else (None, None)
        for r in rows:
            found = tuple(r[c] for c in [self.version, *self.rest])
            if newest is None or found[0] > newest[0]:
                newest = found
            expires = max(int(r[self.time].timestamp() * 1000) + self.quiet_ms, expires or 0)
        if held and held[-1] != expires:
            self.handle.deleteTimer(held[-1])
        if not held or held[-1] != expires:
            self.handle.registerTimer(expires)
        self.latest.update((*newest, expires))
        yield self.row(key, newest, "live")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        newest = tuple(self.latest.get()[:-1])
        self.latest.clear()
        yield self.row(key, newest, "expired")

    def row(self, key, newest: tuple, status: str) -> Row:
        return Row(*self.key, self.version, *self.rest, "status")(*key, *newest, status)

    def close(self) -> None:
        pass


def latest_by_key(stream: DataFrame, key: list[str], version: str, time: str, rest: list[str], quiet: str, delay: str = "1 day") -> DataFrame:
    """(key, version, rest, status): changes of the keyed state over the batches of a stream.

    The newest version of a key wins whatever the order of arrival; rows older than the watermark are dropped; a key without
    events for ``quiet`` before the watermark is forgotten and said to be ``expired``. State lives in the state store and
    its checkpoint, so a run goes on where the last one stopped; nothing of it is in the driver or a Python worker.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    cols = [*key, version, *rest]
    schema = stream.schema
    out = T.StructType([schema[c] for c in cols] + [T.StructField("status", T.StringType())])
    quiet_ms = int(spark.range(1).select(F.expr(f"unix_millis(timestamp '1970-01-02' + interval {quiet}) - unix_millis(timestamp '1970-01-02')")).first()[0])
    held = stream.select(*cols, time).withWatermark(time, delay).groupBy(*key)
    return held.transformWithState(LatestVersion(key, version, time, rest, quiet_ms, schema), out, "Update", "eventTime")


def change_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: the changes of a batch as one increment, a batch that is run again overwrites its own."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return sink


def read_changes(stream_schema: T.StructType, spark, path: str, key: list[str]) -> DataFrame:
    """The last change of each key: the later batch, and in one batch the expiry after the change."""
    schema = T.StructType([*stream_schema.fields, T.StructField("epoch", T.IntegerType())])
    t = spark.read.schema(schema).parquet(*[f"{path}/epoch={e}" for e in _written(spark, path, "epoch")])
    rest = [c for c in t.columns if c not in (*key, "epoch")]
    last = F.max_by(F.struct(*rest), F.struct("epoch", F.col("status") == "expired"))
    return t.groupBy(*key).agg(last.alias("r")).select(*key, "r.*")
