"""Keyed state over batches: late rows, expiry, and going on from the checkpoint after a stop."""
import datetime as dt

from faultline.streaming import jobs, state

SCHEMA = "k int, version long, ts timestamp, value string"


def at(day, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


def test_state_goes_on_after_a_restart(spark, tmp_path):
    """Each batch is a run of its own on the same checkpoint, as a job that was stopped in between."""
    batches = [
        [(1, 10, at(0), "a"), (2, 20, at(0), "b"), (3, 30, at(0), "c")],
        [(1, 9, at(3), "older version"), (2, 21, at(3), "newer"), (4, 40, at(3), "d")],
        [(4, 39, at(0, 1), "late and dropped"), (2, 22, at(9), "e")],        # watermark was day 2, is day 8 afterwards
        [(3, 31, at(9), "again"), (5, 50, at(9), "f")],
    ]
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "cp"))
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(source)      # several files a batch
        stream = jobs.file_stream(spark, source, spark.createDataFrame([], SCHEMA).schema)
        changes = state.latest_by_key(stream, ["k"], "version", "ts", ["value"], "4 days")
        jobs.run_batches(changes, state.change_sink(sink), check, mode="update")
        seen.append({r.k: (r.version, r.value, r.status) for r in state.read_changes(changes.schema, spark, sink, ["k"]).collect()})
    assert seen[0] == {1: (10, "a", "live"), 2: (20, "b", "live"), 3: (30, "c", "live")}
    assert seen[1] == {1: (10, "a", "live"), 2: (21, "newer", "live"), 3: (30, "c", "live"), 4: (40, "d", "live")}
    # day 8: key 3 was last met on day 0, keys 1 and 4 on day 3
    assert seen[2] == {1: (10, "a", "expired"), 2: (22, "e", "live"), 3: (30, "c", "expired"), 4: (40, "d", "expired")}
    assert seen[3] == seen[2] | {3: (31, "again", "live"), 5: (50, "f", "live")}
