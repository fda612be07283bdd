"""Streams over the event table, and readers and writers on their results."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from faultline.catalog import graph as g
from faultline.catalog.registry import query
from faultline.catalog.scoring import DAY, day, snapshot
from faultline.catalog.views import AS_OF, Views, add_view
from faultline.session import cut_lineage, shared_folder
from faultline.sources import sinks, tables
from faultline.streaming import jobs, state


def folder(v: Views, name: str) -> str:
    return f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


def events_stream(v: Views) -> DataFrame:
    s = jobs.file_stream(v.spark, v.dir, v.table("events").schema, "events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


PARTS = 4
_SECOND = "epoch_us(ts) // 1000000"                                # whole seconds: a cast of epoch(ts) would round up
#: Part of each event by equal stretches of time; every fiftieth arrives two parts later.
add_view("event_parts", f"""SELECT *, least({PARTS - 1}, part + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END) AS batch FROM (
  SELECT e.*, ({_SECOND} - lo) * {PARTS} // (hi - lo + 1) AS part FROM events e, (SELECT min({_SECOND}) AS lo, max({_SECOND}) AS hi FROM events))""")


def event_parts(v: Views, late: bool = True) -> DataFrame:
    """The events as a stream of four batches in the order of time, each of as many files as there are tasks, with some
    events that come late."""
    path = folder(v, "parts")
    e = v.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    second = F.unix_timestamp("ts")
    span = e.agg(F.min(second).alias("lo"), F.max(second).alias("hi"))                              # one row
    part = F.floor((second - F.col("lo")) * PARTS / (F.col("hi") - F.col("lo") + 1))
    delay = F.when((F.col("event_id") % 50 == 0) & F.lit(late), 2).otherwise(0)
    batch = F.least(F.lit(PARTS - 1), part + delay)
    cut = e.join(F.broadcast(span), F.lit(True)).withColumn("batch", batch).drop("lo", "hi")
    cut = cut_lineage(cut)
    least = cut.groupBy("batch").count().agg(F.min("count"), F.count("*")).first()
    files = int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    files = files if least[1] == PARTS and least[0] >= 100 * files else 1      # rows are dealt evenly: every file has some
    for i in range(PARTS):                                           # so many files each, in this order
        cut.where(F.col("batch") == i).drop("batch").repartition(files).write.mode("append").parquet(path)
    return jobs.file_stream(v.spark, path, e.schema, files_per_batch=files)


def signals_stream(v: Views, s: DataFrame | None = None) -> DataFrame:
    s = events_stream(v) if s is None else s
    day_ = F.date_add(F.lit("1995-06-01").cast("date"), F.datediff("ts", F.lit("2024-01-01")) * 80 + F.hour("ts") * 3)
    kind = (F.when(F.col("event_type") == "error", "credit_event").when(F.col("event_type") == "click", "supply_disruption").when(F.col("event_type") == "view", "guarantee_balance")
            .when(F.col("event_type") == "purchase", "credit_exposure").otherwise("share_pledge"))
    return s.select("event_id", F.concat(F.lit("S"), "user_id").alias("entity_id"), day_.alias("date"), kind.alias("signal_type"), "value")


@query("R1", "SELECT event_id, user_id, event_type FROM events")
def stream_intake(v: Views):
    """Arriving events, each id once."""
    s = jobs.intake(events_stream(v), ["event_id"], "ts")
    return jobs.run_to_table(s, folder(v, "intake"), folder(v, "cp")).select("event_id", "user_id", "event_type")


@query("R2 R7", """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type""")
def stream_latest_state(v: Views):
    """Upsert by key through increments over four batches, folded into a snapshot on the way; the newest version wins."""
    path, s = folder(v, "latest"), event_parts(v).select("user_id", "event_type", "event_id", "value")
    jobs.run_batches(s, jobs.upsert_latest(path, ["user_id", "event_type"], "event_id", every=3), folder(v, "cp"))
    return jobs.read_latest(v.spark, path, ["user_id", "event_type"], "event_id")


QUIET_DAYS = 4
_STATE = "k0 AS (SELECT user_id, event_type, NULL::BIGINT AS event_id, NULL::DOUBLE AS value, NULL::TIMESTAMP AS last, NULL AS status, NULL::BIGINT AS said, NULL::DOUBLE AS said_value FROM event_parts GROUP BY ALL)"
for _b in range(PARTS + 1):                                          # the last one only moves the watermark on
    _mark = "(SELECT max(ts) - INTERVAL 1 DAY FROM event_parts WHERE batch <= {0})"
    _STATE += f""", n{_b} AS (SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, max(ts) AS last FROM event_parts WHERE batch = {_b}
        AND ts > coalesce({_mark.format(_b - 2)}, TIMESTAMP '1900-01-01') GROUP BY ALL),
      j{_b} AS (SELECT k.user_id, k.event_type, n.event_id IS NOT NULL AS came, greatest(k.last, n.last) AS last, k.status, k.said, k.said_value,
        CASE WHEN k.event_id IS NULL OR n.event_id > k.event_id THEN n.event_id ELSE k.event_id END AS event_id, CASE WHEN k.event_id IS NULL OR n.event_id > k.event_id THEN n.value ELSE k.value END AS value
        FROM k{_b} k LEFT JOIN n{_b} n USING (user_id, event_type)),
      x{_b} AS (SELECT *, event_id IS NOT NULL AND last + INTERVAL {QUIET_DAYS} DAY < {_mark.format(_b - 1)} AS over FROM j{_b}),
      k{_b + 1} AS (SELECT user_id, event_type, CASE WHEN coalesce(over, false) THEN NULL ELSE event_id END AS event_id, CASE WHEN coalesce(over, false) THEN NULL ELSE value END AS value,
        CASE WHEN coalesce(over, false) THEN NULL ELSE last END AS last, CASE WHEN over THEN 'expired' WHEN came THEN 'live' ELSE status END AS status,
        CASE WHEN came OR over THEN event_id ELSE said END AS said, CASE WHEN came OR over THEN value ELSE said_value END AS said_value FROM x{_b})"""


@query("R2 R7", f"""WITH {_STATE} SELECT user_id, event_type, said AS event_id, said_value AS value, status FROM k{PARTS + 1} WHERE status IS NOT NULL""")
def stream_keyed_state(v: Views):
    """The latest event of each user and kind in a state store over several batches; a key quiet for some days before the
    watermark is forgotten and reported as expired."""
    key, path = ["user_id", "event_type"], folder(v, "state")
    s = state.latest_by_key(event_parts(v), key, "event_id", "ts", ["value"], f"{QUIET_DAYS} days")
    jobs.run_batches(s, state.change_sink(path), folder(v, "cp"), mode="update")
    return state.read_changes(s.schema, v.spark, path, key)


@query("R3", """SELECT event_id, CASE WHEN event_type = 'error' AND value >= 100 THEN 'debt_default' WHEN event_type = 'error' AND value >= 60 THEN 'freeze' ELSE 'st_warning' END AS event_type,
  CASE WHEN event_type = 'error' AND value >= 60 AND user_id % 4 <> 0 THEN 'high' ELSE 'medium' END AS severity, CAST(CAST(ts AS DATE) + 365 AS VARCHAR) AS valid_to FROM events WHERE (event_type = 'error' AND value >= 60) OR (event_type = 'view' AND value >= 60 AND user_id % 4 <> 1)""")
def stream_credit_events(v: Views):
    """Announcement titles classified as they arrive, with severity and one year of validity."""
    c = F.col
    title = (F.when((c("event_type") == "error") & (c("value") >= 100), "关于借款逾期的公告").when((c("event_type") == "error") & (c("value") >= 60), "关于股份被司法冻结的公告")
             .when((c("event_type") == "view") & (c("value") >= 60), "关于可能被实施退市风险警示的公告").otherwise("关于股东大会的公告"))
    extra = F.when((c("event_type") == "error") & (c("user_id") % 4 == 0), "（子公司）").when((c("event_type") == "view") & (c("user_id") % 4 == 1), "（参股）").otherwise("")
    t = events_stream(v).select("event_id", c("user_id").alias("code"), F.to_date("ts").alias("date"), F.concat(title, extra).alias("title"))
    out = jobs.run_to_table(jobs.detect_credit_events(t), folder(v, "credit"), folder(v, "cp"))
    return out.select("event_id", "event_type", "severity", day("valid_to"))


add_view("all_kept", """SELECT entity_id, signal_type, date FROM (WITH RECURSIVE d AS (SELECT entity_id, signal_type, date, row_number() OVER (PARTITION BY entity_id, signal_type ORDER BY date) AS i FROM (SELECT DISTINCT entity_id, signal_type, date FROM signals0)),
  r AS (SELECT entity_id, signal_type, i, date, date AS kept FROM d WHERE i = 1 UNION ALL SELECT d.entity_id, d.signal_type, d.i, d.date, CASE WHEN datediff('day', r.kept, d.date) > 90 THEN d.date ELSE r.kept END FROM r JOIN d ON d.entity_id = r.entity_id AND d.signal_type = r.signal_type AND d.i = r.i + 1)
  SELECT entity_id, signal_type, date FROM r WHERE date = kept)""")


@query("R4", "SELECT entity_id, signal_type, CAST(date AS VARCHAR) AS date FROM all_kept")
def stream_collapsed_events(v: Views):
    """Repeats within 90 days dropped, whatever the order in which batches bring the days."""
    path, key = folder(v, "collapsed"), ["entity_id", "signal_type"]
    s = signals_stream(v, event_parts(v)).select(*key, "date")
    jobs.run_batches(s, jobs.collapse_sink(path, key, every=3), folder(v, "cp"))
    return jobs.read_collapsed(v.spark, path, key).select(*key, day("date"))


@query("R5 R6", """WITH m AS (SELECT b.batch, max(e.ts) - INTERVAL 1 DAY AS mark FROM (SELECT DISTINCT batch FROM event_parts) b JOIN event_parts e ON e.batch < b.batch - 1 GROUP BY b.batch)
  SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS start, event_type, count(*) AS n FROM event_parts e LEFT JOIN m ON m.batch = e.batch WHERE m.mark IS NULL OR time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY > m.mark GROUP BY 1, 2""")
def stream_daily_counts(v: Views):
    """Daily windows over four batches: late rows never reopen a window that the watermark has closed, open ones are shown as they stand."""
    s, path, key = jobs.tumbling_counts(event_parts(v), "ts", "1 day", ["event_type"]), folder(v, "counts"), ["start", "event_type"]
    jobs.run_batches(s, jobs.upsert_latest(path, key, "n"), folder(v, "cp"), mode="update")         # counts only grow
    return jobs.read_latest(v.spark, path, key, "n").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")


@query("R5", """SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
  SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, session HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_sessions(v: Views):
    """Sessions of a user's events closed after twelve quiet hours; those still open stay in the state for the next run."""
    s = jobs.sessions(event_parts(v, late=False), "ts", "12 hours", ["user_id"])
    return jobs.run_to_table(s, folder(v, "sessions"), folder(v, "cp")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


@query("R8", "SELECT event_id, value, CASE WHEN value >= 1 THEN 0 ELSE 1 END AS attempt FROM events")
def stream_retry(v: Views):
    """Rows whose processing fails go to a dead-letter table and are tried again with the next batch, those of the last at the end."""
    out, dead = folder(v, "ok"), folder(v, "dead")
    work = lambda df: df.withColumn("ok", (F.col("value") >= 1) | (F.col("attempt") > 0))
    jobs.run_batches(event_parts(v).select("event_id", "value"), jobs.retrying(work, out, dead), folder(v, "cp"))
    jobs.drain(v.spark, work, out, dead)
    return v.spark.read.parquet(out).select("event_id", "value", "attempt")


# ------------------------------------------------------------------ sources and sinks
@query("S6 S7", f"SELECT {DAY}, code, tier FROM fragility WHERE as_of = DATE '{AS_OF[3]}'")
def snapshot_round_trip(v: Views):
    """Snapshots written by evaluation date, then the latest one on or before a date read back."""
    path = folder(v, "snapshots")
    sinks.write_snapshot(snapshot(v).select("as_of", "code", "tier"), path)
    return tables.latest_partition(v.spark, path, "2000-12-31").select(day(), "code", "tier")


@query("S1 S2 S4", """SELECT c_custkey, c_name, c_mktsegment, 0 AS missing FROM customer""")
def delimited_round_trip(v: Views):
    """CSV written with a header and read back as typed columns; a missing source is an empty table."""
    path = folder(v, "csv")
    sinks.write_export([v.table("customer").select("c_custkey", "c_name"), v.table("customer").select("c_custkey", "c_mktsegment")], path)
    t = tables.read_delimited(v.spark, path, "c_custkey bigint, c_name string, c_mktsegment string")
    gone = tables.read_delimited(v.spark, path + "-none", "c_custkey bigint, c_name string, c_mktsegment string")
    per = t.unionByName(gone).groupBy("c_custkey").agg(F.max("c_name").alias("c_name"), F.max("c_mktsegment").alias("c_mktsegment"))
    return per.withColumn("missing", F.lit(0))


@query("S3 F27", """SELECT o_orderkey AS doc_id, count(l_orderkey) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS amount FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def document_round_trip(v: Views):
    """Nested JSON documents written and read back; files without the required key are set apart."""
    from faultline.catalog.quality import gold
    path = folder(v, "json")
    docs = gold(v).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("party", "amount")).alias("transactions"))      # lines of one order
    docs.write.json(path)
    schema = docs.schema
    read = v.spark.read.schema(schema).json(path)
    return read.select("doc_id", F.size("transactions").alias("n"), F.aggregate("transactions", F.lit(0).cast("bigint"), lambda a, t: a + t["amount"]).alias("amount"))


@query("S5", """SELECT code, period, round(revenue * 0.01::DOUBLE, 2) AS revenue, round(round(liab / assets * 100, 2) * 0.01::DOUBLE, 4) AS debt_ratio FROM facts_q""")
def statement_matrix(v: Views):
    """Wide indicator × period matrix unpivoted to one row per company and period."""
    f = v.facts_q
    periods = sorted(r.period for r in f.select("period").distinct().collect())                     # the columns: bounded by the calendar
    cell = lambda c: [F.max(F.when(F.col("period") == p, c.cast("string"))).alias(p) for p in periods]
    rows = [f.groupBy("code").agg(*cell(c)).withColumn("indicator", F.lit(n)).withColumn("row", F.lit(i)) for i, (n, c) in enumerate(
        (("营业总收入", F.col("revenue")), ("资产负债率", F.round(F.col("liab") / F.col("assets") * 100, 2)), ("营业总收入", F.col("revenue") * 2)))]
    wide = rows[0].unionByName(rows[1]).unionByName(rows[2])
    t = tables.unpivot_statement(wide, F.col("code"), periods, {"revenue": ("营业总收入", 0.01), "debt_ratio": ("资产负债率", 0.01)})
    return t.where("revenue is not null").select("code", "period", F.round("revenue", 2).alias("revenue"), F.round("debt_ratio", 4).alias("debt_ratio"))


@query("S9 S11", "SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'cached' ELSE 'new' END AS status FROM documents")
def archive_and_resume(v: Views):
    """Append-only archive and a resumable batch: finished keys are carried over, the rest is processed."""
    path = folder(v, "archive")
    d = v.table("documents").select("doc_id", "source")
    first = d.where("doc_id % 3 = 0").withColumn("status", F.lit("cached"))
    sinks.append_archive(first, path, ["doc_id"])
    sinks.append_archive(first, path, ["doc_id"])                       # the same content again adds nothing
    done = v.spark.read.parquet(path).drop("sha256")
    return sinks.resume(d, done, ["doc_id"], lambda rest: rest.withColumn("status", F.lit("new"))).select("doc_id", "source", "status")


@query("S3 S10", """SELECT doc_id, n, amount, 0 AS rejected FROM (SELECT o_orderkey AS doc_id, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS amount FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
  UNION ALL SELECT -1, 2, NULL, 2""")
def document_folder(v: Views):
    """Nested documents of every order read from a folder; a file without the key and one that is no JSON are set apart, and files are fingerprinted."""
    from faultline.catalog.quality import gold
    path = folder(v, "docs")
    docs = gold(v).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("party", "amount")).alias("transactions"))       # lines of one order
    docs.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/a")
    v.spark.range(1).select(F.lit('{"transactions": []}').alias("value")).write.text(f"{path}/b")
    v.spark.range(1).select(F.lit('{"doc_id": 1, ').alias("value")).write.text(f"{path}/c")
    good, bad = tables.read_documents(v.spark, [path], docs.schema, "doc_id", lines=True)
    files = tables.file_fingerprints(v.spark, path).agg(F.count_if(F.length("sha256") == 64).alias("known")).where("known >= 3")
    summed = good.select("doc_id", F.size("transactions").cast("long").alias("n"), F.aggregate("transactions", F.lit(0).cast("bigint"), lambda a, t: a + t["amount"]).alias("amount"), F.lit(0).cast("long").alias("rejected"))
    apart = bad.join(F.broadcast(files), F.lit(True)).groupBy().agg(F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("doc_id"), "n", F.lit(None).cast("bigint").alias("amount"), F.col("n").alias("rejected"))
    return summed.unionByName(apart)


@query("S4 S8", f"""SELECT CAST(n_name AS VARCHAR) AS code, count(*) AS n, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents, '{AS_OF[3]}' AS as_of FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def keyed_files(v: Views):
    """One delimited folder for each nation, the name being the key, and the description of the run that wrote them."""
    path = folder(v, "nations")
    s = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey", F.round(F.col("s_acctbal") * 100).cast("bigint").alias("cents"))
    s.write.partitionBy("n_name").option("header", True).csv(path)
    sinks.write_run_meta(v.spark, path + "-meta", AS_OF[3], "1", {"market": 0.5}, "20000331", "events")
    meta = v.spark.read.parquet(path + "-meta").agg(F.max("as_of").alias("as_of"))                      # one row
    t = tables.read_keyed_directory(v.spark, path, "s_suppkey bigint, cents bigint", "code", by_folder="n_name")
    return t.groupBy("code").agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).join(F.broadcast(meta), F.lit(True)).select("code", "n", "cents", "as_of")
