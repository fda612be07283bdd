"""Capacity announcements, an order each: line items give records, events and the wording of the pages."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from faultline import rules
from faultline.catalog.quality import gold
from faultline.catalog.registry import query
from faultline.catalog.views import Views, add_view
from faultline.plans import capacity as cp

TYPES = ["capacity_construction", "capacity_replacement", "termination", "suspension", "delay", "commissioning"]
#: Evidence of a record by its number modulo 13; {q} is the amount.
WORDING = ["新增产能{q}万吨/年", "其中：一期{q}万吨/年", "其中：二期{q}万吨/年", "现有{q}万吨装置", "项目建成后预计可年产{q}万吨", "淘汰现有{q}万吨/年装置", "高炉一座{q}m³", "配套{q}台设备",
           "年产{q}万吨钢材项目", "检修7天，减少产量{q}万吨", "总投资{q}亿元", "规模未定", "热轧线{q}万吨"]
UNITS = ["万吨/年", "万吨/年", "万吨/年", "万吨", "万吨", "万吨/年", "m³", "台", "万吨", "万吨/年", "亿元", None, "万吨"]


def lines(v: Views) -> DataFrame:
    """Lines with their event, amount and evidence."""
    c = F.col
    g = gold(v).withColumn("event_index", F.floor((c("idx") - 1) / 3).cast("int")).withColumn("t", (c("k") % len(WORDING)).cast("int"))
    event = W.partitionBy("doc", "event_index")                      # three lines at most
    parts = F.sum(F.when(c("t").isin(1, 2), c("qty"))).over(event)
    g = g.withColumn("q", F.when((c("t") == 0) & parts.isNotNull(), parts).otherwise(c("qty")).cast("long")).withColumn("first", F.min_by("q", "idx").over(event))
    pick = lambda table: F.element_at(F.array(*map(F.lit, table)), c("t") + 1)
    return (g.withColumn("evidence", F.replace(pick(WORDING), F.lit("{q}"), c("q").cast("string"))).withColumn("unit", pick(UNITS))
            .withColumn("action", F.when(c("t").isin(3, 5), "retired").otherwise("new")).withColumn("capacity", F.when(c("t") != 11, c("q").cast("double"))))


def events(v: Views) -> DataFrame:
    c = F.col
    r = F.struct(c("idx").alias("record_index"), "action", F.lit(None).cast("string").alias("facility"), F.concat(F.lit("F"), c("t")).alias("product"), "capacity", "unit",
                 (c("event_index") + 1).alias("page"), "evidence")
    e = lines(v).groupBy("doc", "event_index").agg(F.array_sort(F.collect_list(r)).alias("records"), F.min("first").alias("first"))
    n = c("doc") + c("event_index")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (n % 6 + 1).cast("int"))
    name = (F.when(n % 5 == 0, None).when(n % 5 <= 2, F.concat(F.lit("P"), "doc", F.lit("项目"))).when(n % 5 == 3, F.concat(c("doc").cast("string"), F.lit("年度投资计划")))
            .otherwise(F.concat(F.lit("年产"), "first", F.lit("万吨轧钢项目"))))
    return e.select("doc", "event_index", kind.alias("event_type"), name.alias("project_name"), "records")


def values(v: Views) -> DataFrame:
    """The investment and the date that an extraction states for each event, and how its page words them."""
    c = F.col
    one = lines(v).groupBy("doc", "event_index").agg(F.min_by(F.struct("amount", "party", "k"), "idx").alias("f")).select("doc", "event_index", "f.*")
    n = F.floor(c("amount") / 100)
    day = F.date_add(F.lit("2020-01-01").cast("date"), (c("k") % 700).cast("int"))
    printed = F.when(c("party") % 3 == 1, F.concat(F.floor(n / 10000).cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0"), F.lit("亿元"))).otherwise(
        F.concat(F.format_number(n, 0), F.lit("万元")))
    money = F.concat(F.when(c("party") % 5 == 2, "注册资本").otherwise("项目总投资"), printed)
    ymd = F.concat(F.year(day), F.lit("年"), F.month(day), F.lit("月"))
    date = (F.when(c("party") % 4 == 0, F.concat(ymd, F.dayofmonth(day), F.lit("日正式投产"))).when(c("party") % 4 == 1, F.concat(F.lit("预计"), ymd, F.dayofmonth(day), F.lit("日投产")))
            .when(c("party") % 4 == 2, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("项目开工"))).otherwise(F.concat(ymd, F.lit("末完工"))))
    stated = F.when(c("party") % 4 == 3, F.last_day(day)).otherwise(day)
    return one.select("doc", "event_index", (n + F.when(c("party") % 7 == 0, 1).otherwise(0)).cast("double").alias("amount"), F.lit("万元").alias("unit"),
                      F.date_add(stated, F.when(c("party") % 11 == 0, 1).otherwise(0)).alias("day"), money.alias("money"), date.alias("date"))


def pages(v: Views) -> DataFrame:
    """A page for each event: its records' evidence, the investment, the date, and what the document says as a whole."""
    text = lines(v).groupBy("doc", "event_index").agg(F.array_sort(F.collect_list(F.struct("idx", "evidence"))).alias("e")).select(
        "doc", "event_index", F.array_join(F.col("e")["evidence"], "。").alias("body"))
    first = F.col("event_index") == 0
    whole = F.concat(F.when(first & (F.col("doc") % 3 == 0), F.concat(F.lit("。生产规模为钢材 "), F.col("doc") % 90 + 10, F.lit(" 万吨/年"))).otherwise(""),
                     F.when(first & (F.col("doc") % 7 == 0), "。采用成熟技术移植，实施升级改造").otherwise(""))
    return (text.join(values(v), ["doc", "event_index"]).select("doc", (F.col("event_index") + 1).alias("page"), F.concat(
        "body", whole, F.lit("。"), "money", F.lit("；"), "date", F.lit("。")).alias("text")))


# ------------------------------------------------------------------ the same as SQL
_PICK = lambda table: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in table) + "][t + 1]"
add_view("c_lines", f"""SELECT *, replace({_PICK(WORDING)}, '{{q}}', CAST(q AS VARCHAR)) AS evidence, {_PICK(UNITS)} AS unit, CASE WHEN t IN (3, 5) THEN 'retired' ELSE 'new' END AS action,
  CASE WHEN t <> 11 THEN CAST(q AS DOUBLE) END AS capacity, first_value(q) OVER (PARTITION BY doc, event_index ORDER BY idx) AS first FROM (
  SELECT *, CAST(CASE WHEN t = 0 THEN coalesce(sum(CASE WHEN t IN (1, 2) THEN qty END) OVER (PARTITION BY doc, event_index), qty) ELSE qty END AS BIGINT) AS q
  FROM (SELECT *, CAST((idx - 1) // 3 AS INT) AS event_index, CAST(k % {len(WORDING)} AS INT) AS t FROM gold))""")
add_view("c_events", f"""SELECT doc, event_index, {str(TYPES)}[CAST(n % 6 AS INT) + 1] AS event_type,
  CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 <= 2 THEN 'P' || doc || '项目' WHEN n % 5 = 3 THEN doc || '年度投资计划' ELSE '年产' || first || '万吨轧钢项目' END AS project_name
  FROM (SELECT doc, event_index, doc + event_index AS n, min(first) AS first FROM c_lines GROUP BY ALL)""")
add_view("c_values", """SELECT doc, event_index, CAST(n + CASE WHEN party % 7 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS amount, n, party, d,
  CAST(CASE WHEN party % 4 = 3 THEN last_day(d) ELSE d END + CAST(CASE WHEN party % 11 = 0 THEN 1 ELSE 0 END AS INT) AS DATE) AS day FROM (
  SELECT doc, event_index, arg_min(amount, idx) // 100 AS n, arg_min(party, idx) AS party, CAST(DATE '2020-01-01' + CAST(arg_min(k, idx) % 700 AS INT) AS DATE) AS d FROM c_lines GROUP BY doc, event_index)""")
add_view("c_records", "SELECT l.*, e.event_type, e.project_name FROM c_lines l JOIN c_events e USING (doc, event_index) WHERE t NOT IN (10, 11)")


@query("E16", """SELECT doc, event_index, idx AS record_index, CASE WHEN t = 11 THEN 'remove_incomplete_capacity_change' ELSE 'remove_monetary_capacity_change' END AS action FROM c_lines WHERE t IN (10, 11)""")
def sanitized_records(v: Views):
    """Records without an amount or unit and those that state money, as the log of their removal."""
    return cp.sanitized(events(v)).select("doc", "event_index", F.explode("log").alias("l")).select("doc", "event_index", "l.record_index", "l.action")


_TARGET = "(SELECT max(o.event_index) FROM c_events o WHERE o.doc = e.doc AND o.project_name = e.project_name AND o.event_type <> 'capacity_replacement')"
add_view("c_merge", f"SELECT e.*, CASE WHEN event_type = 'capacity_replacement' THEN {_TARGET} END AS target FROM c_events e")
add_view("c_plan", "SELECT doc, min(event_index) AS plan FROM c_merge WHERE target IS NULL AND project_name LIKE '%年度投资计划%' GROUP BY doc")
add_view("c_left", """SELECT m.* FROM c_merge m LEFT JOIN c_plan p USING (doc) WHERE target IS NULL AND (plan IS NULL OR event_index = plan OR event_type IN ('delay', 'suspension', 'termination'))""")


@query("E17", """SELECT l.doc, l.event_index, event_type, count(*) AS records, array_to_string(list(r.product || ':' || CAST(r.capacity AS BIGINT) ORDER BY r.src <> r.home, r.src, r.idx), ',') AS keys FROM c_left l JOIN (
    SELECT doc, home, src, idx, product, capacity FROM (SELECT *, row_number() OVER (PARTITION BY doc, home, (src <> home), CASE WHEN src <> home THEN (action, product, capacity, unit, page) ELSE (idx::VARCHAR, '', 0.0, '', 0) END ORDER BY src, idx) AS rk,
      bool_or(src = home) OVER (PARTITION BY doc, home, action, product, capacity, unit, page) AS own FROM (
      SELECT x.doc, coalesce(m.target, x.event_index) AS home, x.event_index AS src, x.idx, x.action, 'F' || x.t AS product, x.capacity, x.unit, x.event_index + 1 AS page
      FROM c_records x JOIN c_merge m ON m.doc = x.doc AND m.event_index = x.event_index)) WHERE src = home OR (rk = 1 AND NOT own)) r ON r.doc = l.doc AND r.home = l.event_index GROUP BY ALL
  UNION ALL SELECT doc, event_index, event_type, 0, '' FROM c_left l WHERE NOT EXISTS (SELECT 1 FROM c_records x JOIN c_merge m ON m.doc = x.doc AND m.event_index = x.event_index WHERE x.doc = l.doc AND coalesce(m.target, x.event_index) = l.event_index)""")
def merged_events_by_project(v: Views):
    """Events after replacement records have joined their project's event and plan items their plan."""
    kept, _ = cp.merged(cp.sanitized(events(v)).drop("log"))
    text = F.transform("records", lambda r: F.concat(r["product"], F.lit(":"), r["capacity"].cast("long").cast("string")))
    return kept.select("doc", "event_index", "event_type", F.size("records").cast("long").alias("records"), F.array_join(text, ",").alias("keys"))


@query("E17", """SELECT doc, event_index, 'merge_project_replacement_event' AS action, target FROM c_merge WHERE target IS NOT NULL
  UNION ALL SELECT m.doc, m.event_index, 'merge_framework_plan_item', plan FROM c_merge m JOIN c_plan USING (doc) WHERE target IS NULL AND event_index <> plan AND event_type NOT IN ('delay', 'suspension', 'termination')""")
def merge_log(v: Views):
    return cp.merged(cp.sanitized(events(v)).drop("log"))[1]


# any record may be the sum of those that "of which" lists beside it, whatever its own wording
add_view("c_sums", """SELECT x.doc, x.event_index, x.idx, x.action, x.unit, x.capacity, count(*) AS listed, sum(s.capacity) AS added FROM c_records x JOIN c_records s
  ON s.doc = x.doc AND s.event_index = x.event_index AND s.idx <> x.idx AND s.action = x.action AND s.unit = x.unit AND s.capacity < x.capacity AND s.t IN (1, 2) GROUP BY ALL""")
add_view("c_rules", """SELECT r.*, doc % 3 = 0 AS formal_doc, event_type = 'capacity_construction' AND doc % 7 = 0 AS retyped,
  bool_or(t = 0 AND action = 'new') OVER (PARTITION BY doc, event_index) AS formal_event, bool_or(t = 4) OVER (PARTITION BY doc, event_index) AS projected,
  t IN (1, 2) AND EXISTS (SELECT 1 FROM c_sums x WHERE x.doc = r.doc AND x.event_index = r.event_index AND x.idx <> r.idx AND x.action = r.action AND x.unit = r.unit AND r.capacity < x.capacity
    AND x.listed >= 2 AND abs(x.added - x.capacity) <= 0.01 * x.capacity) AS part FROM c_records r""")
_ADVERSE = "event_type IN ('termination', 'suspension', 'delay')"
_BUILD = "event_type = 'capacity_construction' AND NOT retyped AND action = 'new' AND (formal_doc OR formal_event) AND t <> 0"


@query("E32 E10 E18", f"""SELECT doc, event_index, idx AS record_index, CASE
    WHEN t = 9 THEN 'move_temporary_loss_to_impact'
    WHEN project_name LIKE '%年度投资计划%' THEN 'remove_framework_item_capacity'
    WHEN coalesce(part, false) THEN 'remove_capacity_breakdown'
    WHEN {_ADVERSE} AND action = 'new' AND (t = 8 OR (project_name LIKE '年产%' AND contains(project_name, CAST(q AS VARCHAR)))) THEN 'remove_planned_capacity_of_adverse_project'
    WHEN t = 3 THEN 'remove_existing_asset_background'
    WHEN {_ADVERSE} AND t = 4 THEN 'remove_hypothetical_adverse_capacity'
    WHEN event_type <> 'capacity_replacement' AND t = 6 THEN 'remove_nonreplacement_equipment_spec'
    WHEN {_BUILD} AND projected THEN 'remove_projected_product_breakdown'
    WHEN {_BUILD} AND t = 7 THEN 'remove_equipment_breakdown' END AS reason FROM c_rules""")
def suppressed_records(v: Views):
    """Every record with the first rule that removes it; null where it stays."""
    before = cp.sanitized(events(v)).drop("log")
    gone = cp.suppressed(before, pages(v)).select("doc", "event_index", F.explode("log").alias("l")).select("doc", "event_index", "l.record_index", F.col("l.action").alias("reason"))
    every = before.select("doc", "event_index", F.explode("records.record_index").alias("record_index"))
    return every.join(gone, ["doc", "event_index", "record_index"], "left")


@query("E18", """SELECT doc, event_index, CASE WHEN retyped THEN 'technical_upgrade' ELSE event_type END AS event_type, loss AS loss_amount, CASE WHEN loss IS NOT NULL THEN '万吨' END AS loss_unit, CASE WHEN loss IS NOT NULL THEN 7.0::DOUBLE END AS days FROM (
  SELECT e.doc, e.event_index, event_type, event_type = 'capacity_construction' AND e.doc % 7 = 0 AS retyped, (SELECT arg_min(capacity, idx) FROM c_records r WHERE r.doc = e.doc AND r.event_index = e.event_index AND t = 9) AS loss FROM c_events e)""")
def event_types_and_losses(v: Views):
    """Constructions retyped as upgrades, and the temporary loss an event states instead of a retirement."""
    e = cp.suppressed(cp.sanitized(events(v)).drop("log"), pages(v))
    return e.select("doc", "event_index", "event_type", F.col("loss.amount").alias("loss_amount"), F.col("loss.unit").alias("loss_unit"), F.col("loss.days").alias("days"))


@query("E33", """SELECT v.doc, v.event_index, amount, source_amount, source_unit FROM c_values v LEFT JOIN (
    SELECT doc, event_index, arg_min(CASE WHEN yi THEN value / 10000.0::DOUBLE ELSE value END, {'r': yi, 'p': page}) AS source_amount, arg_min(CASE WHEN yi THEN '亿元' ELSE '万元' END, {'r': yi, 'p': page}) AS source_unit FROM (
      SELECT v.doc, v.event_index, v.amount AS value, p.event_index AS page, p.party % 3 = 1 AS yi FROM c_values v JOIN c_values p ON p.doc = v.doc AND CAST(p.n AS DOUBLE) = v.amount AND p.party % 5 <> 2
      UNION ALL SELECT v.doc, v.event_index, v.amount, l.event_index, true FROM c_values v JOIN c_lines l ON l.doc = v.doc AND l.t = 10 AND l.q * 10000.0::DOUBLE = v.amount) GROUP BY ALL) s
  ON s.doc = v.doc AND s.event_index = v.event_index""")
def investment_support(v: Views):
    """The form in which the document prints an event's investment; null where it prints none, or as capital only."""
    p = v.stored("capacity_pages", pages)
    return cp.supported_investments(values(v).select("doc", "event_index", "amount", "unit"), p).select("doc", "event_index", "amount", "source_amount", "source_unit")


@query("E33", """SELECT v.doc, v.event_index, CAST(v.day AS VARCHAR) AS day, EXISTS (SELECT 1 FROM c_values p WHERE p.doc = v.doc AND CASE WHEN p.party % 4 = 3 THEN last_day(p.d) ELSE p.d END = v.day) AS printed,
  EXISTS (SELECT 1 FROM c_values p WHERE p.doc = v.doc AND p.party % 4 = 0 AND p.d = v.day) AS commissioned FROM c_values v""")
def date_support(v: Views):
    """Whether the document prints an event's date, as a day or as an end of month, and whether as an actual start."""
    p = v.stored("capacity_pages", pages)
    return cp.supported_dates(values(v).select("doc", "event_index", "day"), p).select("doc", "event_index", F.col("day").cast("string").alias("day"), "printed", "commissioned")


@query("E34", """SELECT doc, event_index, capacity, '万吨/年' AS unit, page FROM (
  SELECT e.doc, e.event_index, coalesce(f.q, CASE WHEN e.doc % 3 = 0 THEN e.doc % 90 + 10 END)::DOUBLE AS capacity, 1 AS page FROM c_events e LEFT JOIN (SELECT doc, arg_min(q, idx) AS q FROM c_lines WHERE false GROUP BY doc) f USING (doc)
  WHERE event_type = 'capacity_construction' AND (SELECT count(*) FROM c_events o WHERE o.doc = e.doc) = 1) x WHERE capacity IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM c_records r WHERE r.doc = x.doc AND r.action = 'new' AND r.capacity = x.capacity AND r.unit = '万吨/年')""")
def recovered_capacity(v: Views):
    """The formal capacity a document states, added where its only event, a construction, lacks it."""
    return cp.recovered_aggregate(cp.sanitized(events(v)).drop("log"), v.stored("capacity_pages", pages))[1]


@query("E32", """SELECT doc, idx AS record_index, k % 3 <> 2 AND k % 5 < 3 AND k % 2 = 0 AS threshold FROM gold""")
def environmental_thresholds(v: Views):
    """Limits that a cited rule sets are no metrics of a project."""
    k = F.col("k")
    said = F.concat(F.when(k % 3 == 2, "排放浓度").otherwise("排放浓度不高于"), "idx", F.lit("mg/m³"))
    metrics = gold(v).select("doc", F.col("idx").alias("page"), F.col("idx").alias("record_index"), said.alias("evidence"), "k")
    rule = F.when(k % 5 < 3, "根据《超低排放意见》").otherwise("根据公司安排")
    text = F.concat(rule, F.when(k % 2 == 0, "要求，").otherwise("，"), F.regexp_replace("evidence", "浓度", "浓 度\n"), F.lit("。"))
    return cp.regulatory_thresholds(metrics, metrics.select("doc", "page", text.alias("text"))).select("doc", "record_index", "threshold")
