"""Titles, items and questions over whole tables, classified by the fixed rule tables.

The texts are put together from keys so that every rule, exclusion and near miss occurs; the SQL states the rules again on
the texts and does not use how they were made.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline import rules
from faultline.catalog.registry import query
from faultline.catalog.scoring import day
from faultline.catalog.views import AS_OF, AS_OF_SQL, Views, add_view
from faultline.functions import text as tx
from faultline.operators.asof import active_as_of
from faultline.plans import documents as dc

HEADS = ("日常关联交易预计", "持续关连交易", "关联交易框架协议", "关联交易的补充协议", "关联交易进展", "为子公司提供担保", "担保逾期", "对外担保发生代偿", "承担连带保证责任",
         "产能置换", "高炉停产检修", "建设项目投产", "项目建设延期", "项目的公开招标", "股份质押", "解除质押", "借款逾期", "债券未能按期兑付", "商票业务", "股份被司法冻结", "银行账户解冻",
         "实施退市风险警示", "申请撤销其他风险警示", "出具保留意见", "信用评级下调", "评级展望调整为负面", "破产重整", "开展外汇衍生品交易", "开展商品期货套期保值", "大宗商品套保",
         "开展外汇与商品衍生品业务", "开展衍生品交易", "汇率波动", "会计政策变更", "会计估计变更", "前期会计差错更正", "年度报告", "技改工程", "其他")
TAILS = ("的公告", "管理制度", "的更正公告", "的法律意见书", "进展公告", "业务管理办法", "（摘要）", "")
ITEMS = ("铁矿石", "冷轧板", "不锈钢冷轧板", "无缝钢管", "螺纹钢", "钢材", "钢坯", "焦炭", "炼焦煤", "硅锰合金", "合金钢棒材", "其他板材", "钢材贸易", "提供劳务", "废钢", "中宽热带", "电力", "焦化产品",
         "H型钢", "板坯", "球团矿", "耐火材料", "内部抵消", " ")
QUESTIONS = ("{c}现在风险怎么样？", "{c}出现风险会波及哪些企业？", "谁出事会拖累{c}？", "哪些企业的风险会传到{c}？", "今天最该关注什么？", "承压最弱的钢厂有哪些？", "铁矿石涨 20% 谁受影响最大？",
             "出口关税提高 10% 对谁影响大？", "这个系统准不准？", "{c}股价走势如何", "今天天气如何", "螺纹钢下跌2成", "现在焦炭 5 个百分点", "{c}的公告怎么看", "热轧价格", "{c}受上游影响吗", "影响谁", "明天吃什么",
             "当前{c}如何", "不锈钢下调 3.5%，{c}第几", "钢厂减产后焦煤 12％")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def sql_pick(values: tuple[str, ...], index: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + f"][CAST({index} % {len(values)} AS INT) + 1]"


def chain(text: str, table, exclude: str | None = None) -> str:
    """The rules as SQL: exclusion, then the first pattern that matches."""
    whens = " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{k}'" for k, p in table)
    return f"CASE {f'''WHEN regexp_matches({text}, '{exclude}') THEN NULL ''' if exclude else ''}{whens} END"


add_view("titles", f"""SELECT o_orderkey AS id, o_custkey AS code, CAST(o_orderdate AS DATE) AS notice_date,
  c_name || '关于' || {sql_pick(HEADS, 'o_orderkey')} || {sql_pick(TAILS, f'(o_orderkey // {len(HEADS)})')} AS title FROM orders JOIN customer ON o_custkey = c_custkey""")


def titles(v: Views) -> DataFrame:
    o = v.table("orders").join(v.table("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("notice_date"),
                    F.concat("c_name", F.lit("关于"), pick(HEADS, k), pick(TAILS, F.floor(k / len(HEADS)))).alias("title"))


@query("F9 F10", f"""SELECT id, {chain('title', rules.CREDIT_RULES, rules.CREDIT_EXCLUDE)} AS event, {chain('title', rules.TITLE_TASKS, rules.TITLE_EXCLUDE)} AS task FROM titles""")
def classified_titles(v: Views):
    """Credit event and task of every title; exclusions come first, then the first rule that matches."""
    return titles(v).select("id", tx.credit_event(F.col("title")).alias("event"), tx.title_task(F.col("title")).alias("task"))


_HEDGE = f"""CASE WHEN NOT regexp_matches(title, '{rules.HEDGE}') THEN NULL WHEN regexp_matches(title, '{rules.HEDGE_FX}') AND NOT regexp_matches(replace(title, '外汇衍生品', ''), '{rules.HEDGE_COMMODITY}') THEN '外汇'
  WHEN regexp_matches(title, '{rules.HEDGE_COMMODITY}') THEN '商品期货' ELSE '未写明品种' END"""


@query("F11 P11", f"""SELECT CAST(as_of AS VARCHAR) AS as_of, code, count(kind) AS titles, bool_or(coalesce(kind = '商品期货' AND NOT policy, false)) AS commodity, bool_or(coalesce(kind = '未写明品种' AND NOT policy, false)) AS unspecified,
  bool_or(coalesce(kind = '外汇' AND NOT policy, false)) AS fx, CASE WHEN count(kind) = 0 THEN 'not_seen' WHEN NOT bool_or(coalesce(NOT policy AND kind IS NOT NULL, false)) THEN 'policy_only' ELSE 'business' END AS label
  FROM (SELECT d.as_of, t.code, CASE WHEN notice_date >= as_of - INTERVAL {rules.HEDGE_MONTHS} MONTH THEN {_HEDGE} END AS kind, regexp_matches(title, '{rules.HEDGE_POLICY}') AS policy
    FROM titles t JOIN {AS_OF_SQL} ON notice_date <= as_of) d(as_of, code, kind, policy) GROUP BY as_of, code""".replace("SELECT d.as_of, t.code", "SELECT as_of, t.code"))
def hedging_titles(v: Views):
    """Kinds of hedging in the titles of the 15 months before each date, business told apart from policy documents."""
    seen = active_as_of(titles(v), AS_OF, F.col("notice_date"), F.lit(None).cast("date"))
    recent = F.col("notice_date") >= F.add_months("as_of", -rules.HEDGE_MONTHS)
    t = seen.select("as_of", "code", F.when(recent, tx.hedging_kind(F.col("title"))).alias("kind"), F.col("title").rlike(rules.HEDGE_POLICY).alias("policy"))
    on = lambda k: F.coalesce(F.bool_or((F.col("kind") == k) & ~F.col("policy")), F.lit(False))
    business = F.coalesce(F.bool_or(F.col("kind").isNotNull() & ~F.col("policy")), F.lit(False))
    label = F.when(F.count("kind") == 0, "not_seen").when(~business, "policy_only").otherwise("business")
    return t.groupBy(day(), "code").agg(F.count("kind").alias("titles"), on("商品期货").alias("commodity"), on("未写明品种").alias("unspecified"), on("外汇").alias("fx"), label.alias("label"))


@query("P11", f"""SELECT CAST(as_of AS VARCHAR) AS as_of, code, count(*) AS changes, CAST(max(notice_date) AS VARCHAR) AS last FROM titles JOIN {AS_OF_SQL}
  ON notice_date BETWEEN as_of - {rules.ACCOUNTING_DAYS} AND as_of WHERE regexp_matches(title, '{rules.ACCOUNTING}') GROUP BY as_of, code""")
def accounting_changes(v: Views):
    """Changes of accounting announced in the 365 days before each date."""
    t = titles(v).where(F.col("title").rlike(rules.ACCOUNTING))
    t = active_as_of(t, AS_OF, F.col("notice_date"), F.date_add("notice_date", rules.ACCOUNTING_DAYS))
    return t.groupBy(day(), "code").agg(F.count("*").alias("changes"), F.max("notice_date").cast("string").alias("last"))


_ITEM = f"{sql_pick(ITEMS, 'p_partkey')}"


@query("F12", f"""SELECT p_partkey, CASE WHEN trim(item) <> '' THEN {chain('item', [(p, w) for p, _, w in rules.PRODUCTS], rules.NOT_PRODUCT)} END AS product FROM (SELECT p_partkey, {_ITEM} AS item FROM part)""")
def product_items(v: Views):
    """Product of each reported item by the priority of the product table."""
    return v.table("part").select("p_partkey", tx.product_of(pick(ITEMS, F.col("p_partkey"))).alias("product"))


@query("F13", f"""SELECT id, coalesce({chain('substr(page, 1, 300)', rules.PAGE_TASKS)}, {chain('substr(page, 1, 3000)', rules.PAGE_TASKS)}) AS task FROM (
  SELECT doc_id AS id, substr(coalesce(text, ''), 1, CAST(doc_id % 7 * 90 AS INT)) || {sql_pick(HEADS, 'doc_id')} || coalesce(text, '') || {sql_pick(HEADS, '(doc_id // 5)')} AS page FROM documents)""")
def page_tasks(v: Views):
    """Task of a document from its head, else from its first pages."""
    text = F.coalesce("text", F.lit(""))
    page = F.concat(F.substring(text, F.lit(1), (F.col("doc_id") % 7 * 90).cast("int")), pick(HEADS, F.col("doc_id")), text, pick(HEADS, F.floor(F.col("doc_id") / 5)))
    return v.table("documents").select(F.col("doc_id").alias("id"), tx.page_task(page).alias("task"))


_Q = f"replace({sql_pick(QUESTIONS, 'c_custkey')}, '{{c}}', 'S' || (c_custkey % 97))"
_PRODUCT_IN = "CASE " + " ".join(f"WHEN contains(q, '{n}') OR regexp_matches(q, '{w}') THEN '{p}'" for p, n, w in rules.PRODUCTS) + " END"
_MENTION = "S[0-9]+"
_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(q, '{p}') {'AND company' if k in rules.COMPANY_INTENTS else 'AND NOT company' if k == 'today' else ''} THEN '{k}'" for k, p in rules.INTENTS) + " END"


@query("F14", f"""WITH a AS (SELECT c_custkey AS id, {_Q} AS q FROM customer), b AS (SELECT *, regexp_matches(q, '{_MENTION}') AS company, {_PRODUCT_IN} AS product, regexp_extract(q, '{rules.MOVE}', 1) AS word,
    regexp_extract(q, '{rules.MOVE}', 2) AS num, regexp_extract(q, '{rules.MOVE}', 3) AS unit FROM a),
  c AS (SELECT *, {_INTENT} AS i0, CASE WHEN num <> '' THEN CAST(num AS DOUBLE) / CASE unit WHEN '成' THEN 10 ELSE 100 END * CASE WHEN regexp_matches(word, '{rules.DOWN}') OR (word = '' AND regexp_matches(q, '{rules.DOWN}')) THEN -1 ELSE 1 END END AS move FROM b),
  d AS (SELECT *, CASE WHEN i0 = 'spread' AND regexp_matches(q, '{rules.SPREAD_VERBS}') AND strpos(q, regexp_extract(q, '{_MENTION}')) > strpos(q, regexp_extract(q, '{rules.SPREAD_VERBS}')) THEN 'exposure' ELSE i0 END AS i1 FROM c),
  e AS (SELECT *, CASE WHEN product IS NOT NULL AND ((i1 IS NULL AND (move IS NOT NULL OR regexp_matches(q, '{rules.PRICE_WORDS}'))) OR (i1 = 'today' AND move IS NOT NULL)) THEN 'price' ELSE i1 END AS i2 FROM d)
  SELECT id, CASE WHEN regexp_matches(q, '{rules.ADVICE}') OR NOT (company OR product IS NOT NULL OR regexp_matches(q, '{rules.DOMAIN}')) THEN 'unsupported' ELSE coalesce(i2, CASE WHEN company THEN 'company' END, 'unsupported') END AS intent,
    product, move FROM e""")
def routed_questions(v: Views):
    """Intent, product and signed move of short questions."""
    q = F.replace(pick(QUESTIONS, F.col("c_custkey")), F.lit("{c}"), F.concat(F.lit("S"), F.col("c_custkey") % 97))
    return v.table("customer").select(F.col("c_custkey").alias("id"), tx.question_route(q, _MENTION).alias("intent"), tx.product_in(q).alias("product"), tx.percent_move(q).alias("move"))


# ------------------------------------------------------------------ capacity and pledge documents, one for each customer
CAPACITY = ("maintenance", "delay", "suspension", "termination", "new_project")
_CAP = f"""SELECT c_custkey AS doc_id, 'C' || c_custkey AS entity, DATE '1995-01-01' + CAST(c_custkey % 2000 AS INT) AS announced, k, {sql_pick(CAPACITY, '(c_custkey + k)')} AS kind, (c_custkey * 7 + k * 13) % 45 AS days,
  (c_custkey * 3 + k) % 70 AS loss, c_custkey % 4 AS u, abs(CAST(round(c_acctbal * 100) AS BIGINT)) / 100.0::DOUBLE AS money FROM customer, (VALUES (0), (1), (2)) t(k)"""
add_view("cap_events", _CAP)


def capacity_documents(v: Views) -> DataFrame:
    c, key = v.table("customer"), F.col("c_custkey")
    money = F.abs(F.round(F.col("c_acctbal") * 100).cast("bigint")) / F.lit(100.0)
    announced = F.date_add(F.lit("1995-01-01").cast("date"), (key % 2000).cast("int"))

    def event(k: int) -> Column:
        days = (key * 7 + k * 13) % 45
        changes = F.array(F.struct(F.when(key % 2 == 0, "new").otherwise("retire").alias("action"), (key % 900).cast("double").alias("capacity")))
        return F.struct(pick(CAPACITY, key + k).alias("event_type"), F.when(key % 3 == 0, F.date_sub(announced, 5)).alias("shutdown_start"), F.when(days > 0, days).cast("int").alias("shutdown_days"),
                        F.when(key % 5 == 0, F.date_add(announced, 20)).alias("restart_date"), ((key * 3 + k) % 70).cast("double").alias("loss"),
                        F.when(key % 4 == 0, "吨").otherwise("万吨钢").alias("loss_unit"), money.alias("investment"), F.when(key % 4 < 2, "万元").when(key % 4 == 2, "亿元").otherwise("吨").alias("investment_unit"), changes.alias("capacity_changes"))

    return c.select(key.alias("doc_id"), F.concat(F.lit("C"), key).alias("issuer_id"), announced.alias("announced"), F.array(*map(event, range(3))).alias("events"))


def pledge_documents(v: Views) -> DataFrame:
    key = F.col("s_suppkey")
    announced = F.date_add(F.lit("1996-03-01").cast("date"), (key % 1500).cast("int"))
    later = lambda every, days: F.when(key % every == 0, F.date_add(announced, days))
    event = F.struct(F.when(key % 6 == 0, "release").otherwise("pledge").alias("event_type"), (key * 1000).alias("shares"), F.when(key % 7 != 0, (key * 11 % 101).cast("double")).alias("holding_ratio"),
                     F.when(key % 5 != 0, (key * 3 % 40).cast("double")).alias("total_ratio"), later(2, -3).alias("start_date"), later(3, 300).alias("end_date"), later(4, 400).alias("extended_date"), later(8, 90).alias("release_date"))
    return v.table("supplier").select(key.alias("doc_id"), F.concat(F.lit("S"), key).alias("issuer_id"), announced.alias("announced"), F.array(event).alias("events"))


_LEVELS = "CASE WHEN {0} THEN 'high' WHEN {1} THEN 'medium' ELSE 'low' END"


@query("G2 F15", f"""SELECT 'C' || doc_id AS doc_id, entity, signal_type, severity, round(magnitude, 4) AS magnitude, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to FROM (
  SELECT doc_id, entity, 'supply_disruption' AS signal_type, {_LEVELS.format("days >= 30 OR (u <> 0 AND loss >= 50)", "days >= 7 OR (u <> 0 AND loss >= 10)")} AS severity, CAST(CASE WHEN days > 0 THEN days END AS DOUBLE) AS magnitude,
    begin AS valid_from, CAST(CASE WHEN doc_id % 5 = 0 THEN announced + 20 WHEN days > 0 THEN begin + CAST(days AS INT) ELSE begin + INTERVAL 3 MONTH END AS DATE) AS valid_to
    FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN announced - 5 ELSE announced END AS begin FROM cap_events) WHERE kind = 'maintenance'
  UNION ALL SELECT doc_id, entity, 'project_delay', CASE kind WHEN 'delay' THEN 'low' ELSE 'medium' END, round(CASE WHEN u < 2 THEN money WHEN u = 2 THEN money * 10000 END, 4), announced, CAST(announced + INTERVAL 12 MONTH AS DATE) FROM cap_events WHERE kind IN ('delay', 'suspension', 'termination')
  UNION ALL SELECT doc_id, entity, CASE WHEN doc_id % 2 = 0 THEN 'capacity_increase' ELSE 'capacity_reduction' END, 'info', CAST(doc_id % 900 AS DOUBLE), announced, CAST(announced + INTERVAL 12 MONTH AS DATE) FROM cap_events WHERE kind <> 'maintenance')
  UNION ALL SELECT 'S' || s_suppkey, 'S' || s_suppkey, 'share_pledge', CASE WHEN held >= 80 THEN CASE WHEN round(total * 100 / held, 2) < 20 THEN 'medium' ELSE 'high' END WHEN held >= 50 THEN 'medium' ELSE 'low' END, CAST(s_suppkey * 1000 AS DOUBLE),
    CAST(begin AS VARCHAR), CAST(CAST(coalesce(CASE WHEN s_suppkey % 8 = 0 THEN announced + 90 END, CASE WHEN s_suppkey % 4 = 0 THEN announced + 400 END, CASE WHEN s_suppkey % 3 = 0 THEN announced + 300 END, begin + INTERVAL 12 MONTH) AS DATE) AS VARCHAR)
    FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN announced - 3 ELSE announced END AS begin FROM (SELECT s_suppkey, DATE '1996-03-01' + CAST(s_suppkey % 1500 AS INT) AS announced, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey * 11 % 101 ELSE 0 END AS held,
      CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 3 % 40 END AS total FROM supplier)) WHERE s_suppkey % 6 <> 0""")
def capacity_and_pledge_signals(v: Views):
    """Signals of outages, projects, capacity changes and share pledges, read from nested documents."""
    a = dc.capacity_signals(capacity_documents(v)).withColumn("doc_id", F.concat(F.lit("C"), "doc_id"))
    b = dc.pledge_signals(pledge_documents(v)).withColumn("doc_id", F.concat(F.lit("S"), "doc_id"))
    return a.unionByName(b).select("doc_id", "entity", "signal_type", "severity", F.round("magnitude", 4).alias("magnitude"), day("valid_from"), day("valid_to"))
