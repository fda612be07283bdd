"""Section, clause and field rules on texts made from orders and lines; scenarios on annualised revenue; margins in words."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from faultline import rules
from faultline.catalog import exposure as xp, graph as g, history as hi
from faultline.catalog.quality import gold
from faultline.catalog.registry import query
from faultline.catalog.readings import scored_steps
from faultline.catalog.scoring import day, snapshot
from faultline.catalog.shocks import FINISHED, shares
from faultline.catalog.views import AS_OF, Views, add_view, cents
from faultline.functions.periods import available_by
from faultline.functions.scalars import lookup
from faultline.operators.asof import latest_as_of
from faultline.operators.graph import ancestors
from faultline.plans import clauses as cl, exposure as ex, statements as st

DAY = "CAST(as_of AS VARCHAR) AS as_of"


# ------------------------------------------------------------------ sections and clauses of guarantees
def guarantee_pages(v: Views) -> DataFrame:
    """A page for each line of an order: a guarantee, in some the cumulative section's heading, in some a quota."""
    k, n = F.col("k"), F.format_number(F.floor(F.col("amount") / 100), 0)
    clause = F.when(k % 4 == 0, "本次担保额度为").when(k % 4 == 1, "担保额度项下余额为").when(k % 4 == 2, "担保额度充足，实际担保").otherwise("对外担保")
    head = F.when(k % 5 == 0, "三、公司 累计对外担保情况。").otherwise("")
    said = F.concat(F.lit("第"), F.col("idx").cast("string"), F.lit("笔："), clause, n, F.lit(" 万元"))
    text = F.when(k % 2 == 0, F.concat(head, said, F.lit("。"))).otherwise(F.concat(said, F.lit("。"), head))
    return gold(v).select("doc", F.col("idx").alias("page"), text.alias("text"), said.alias("evidence"), F.floor(F.col("amount") / 100).cast("double").alias("amount"))


@query("E13", """SELECT doc, page, CASE WHEN head IS NULL OR page < head THEN false WHEN page > head THEN true ELSE front END AS cumulative FROM (
  SELECT doc, idx AS page, k % 2 = 0 AS front, min(CASE WHEN k % 5 = 0 THEN idx END) OVER (PARTITION BY doc) AS head FROM gold)""")
def cumulative_sections(v: Views):
    """Guarantees that a document lists as cumulative ones, by heading, page and place on the page."""
    p = v.stored("guarantee_pages", guarantee_pages)
    return cl.in_cumulative_section(p.select("doc", "page", "evidence"), p.select("doc", "page", "text")).select("doc", "page", "cumulative")


@query("E13", """SELECT a.doc, a.idx AS page, bool_and(b.k % 4 = 0) AS quota FROM gold a JOIN gold b ON b.doc = a.doc AND b.amount // 100 = a.amount // 100 GROUP BY a.doc, a.idx""")
def quota_clauses(v: Views):
    """Amounts that are always introduced as a quota, never as a balance."""
    p = v.stored("guarantee_pages", guarantee_pages)
    values = p.select("doc", F.col("page").alias("event_index"), "amount", F.lit("万元").alias("unit"))
    return cl.quota_only(values, p.select("doc", "page", "text")).select("doc", F.col("event_index").alias("page"), "quota")


# ------------------------------------------------------------------ pledges and empty extractions
_TYPES = ["release", "extension", "pledge"]
_WHEN = "CASE k % 5 WHEN 0 THEN strftime(DATE '2020-01-01' + CAST(k % 90 AS INT), '%Y-%m-%d') WHEN 1 THEN '2020年 3月5日' WHEN 2 THEN '办理解除手续之日' WHEN 3 THEN '2020年3月5日起' END"


@query("E15", f"""SELECT doc, idx, CASE WHEN t = 'release' THEN NULL ELSE k % 2 = 0 END AS restricted, CASE WHEN t = 'release' AND k % 3 = 0 THEN NULL ELSE CAST(d AS VARCHAR) END AS ends,
  CASE WHEN t = 'extension' AND k % 5 IN (0, 1) THEN NULL ELSE c END AS condition, CASE WHEN t = 'release' THEN 1 + CAST(k % 3 = 0 AS INT) WHEN t = 'extension' AND k % 5 IN (0, 1) THEN 1 ELSE 0 END AS cleared
  FROM (SELECT doc, idx, k, {_TYPES}[CAST(party % 3 AS INT) + 1] AS t, CAST(DATE '2020-01-01' + CAST(k % 90 AS INT) AS DATE) AS d, {_WHEN} AS c FROM gold)""")
def pledge_conflicts(v: Views):
    """Pledge fields that conflict with their event type are cleared and counted."""
    k = F.col("k")
    d = F.date_add(F.lit("2020-01-01").cast("date"), (k % 90).cast("int"))
    condition = F.when(k % 5 == 0, d.cast("string")).when(k % 5 == 1, "2020年 3月5日").when(k % 5 == 2, "办理解除手续之日").when(k % 5 == 3, "2020年3月5日起")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("party") % 3 + 1).cast("int"))
    e = gold(v).select("doc", "idx", kind.alias("event_type"), (k % 2 == 0).alias("is_restricted_share"), F.lit(None).cast("boolean").alias("is_supplementary_pledge"),
                       d.alias("pledge_end_date"), F.date_add(d, F.when(k % 3 == 0, 0).otherwise(7)).alias("release_date"), condition.alias("pledge_end_condition"))
    c = cl.cleared_pledges(e)
    return c.select("doc", "idx", F.col("is_restricted_share").alias("restricted"), F.col("pledge_end_date").cast("string").alias("ends"), F.col("pledge_end_condition").alias("condition"),
                    F.size("log").alias("cleared"))


@query("E31", """SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 IN (0, 3) AND o_orderkey % 5 <> 4 THEN 'binding_project_agreement_with_capacity' END AS reason FROM orders""")
def retry_candidates(v: Views):
    """Documents without an extracted event that nevertheless sign a project agreement with a capacity."""
    k = F.col("o_orderkey")
    ending = F.when(k % 7 == 0, "项目合资协议").when(k % 7 == 3, "项目 投资协议").when(k % 7 == 5, "框架协议").otherwise("项目投资协议书")
    size = F.when(k % 5 == 4, "一期").otherwise(F.concat(F.lit("年产"), k % 90 + 1, F.lit("万吨钢材")))
    text = F.concat(F.lit("公司于近日签署《"), size, ending, F.lit("》并公告\n签署《保密协议》"))
    return v.table("orders").select(k.alias("doc"), cl.retry_reason(k % 3, text).alias("reason"))


# ------------------------------------------------------------------ relationships that the entity table implies
SCOPES = ["self", "self_and_subsidiaries", "subsidiaries", "associates"]
add_view("up_chain", """WITH RECURSIVE p AS (SELECT s_suppkey AS node, s_suppkey // 3 AS parent FROM supplier WHERE s_suppkey > 0),
  a AS (SELECT node, parent AS ancestor FROM p UNION SELECT a.node, p.parent FROM a JOIN p ON p.node = a.ancestor) SELECT * FROM a""")


@query("G15", f"""SELECT issuer, entity, scope, CASE WHEN issuer = entity THEN CASE WHEN scope = 'associates' THEN 'associate_or_joint_venture' END
    WHEN EXISTS (SELECT 1 FROM up_chain u WHERE 'S' || u.node = issuer AND 'S' || u.ancestor = entity) THEN CASE scope WHEN 'subsidiaries' THEN 'sister_company' WHEN 'associates' THEN 'other_related_party' ELSE 'parent_or_controlling_shareholder' END END AS implied, count(*) AS n
  FROM (SELECT 'S' || party AS issuer, 'S' || CASE k % 4 WHEN 0 THEN party WHEN 1 THEN party // 3 WHEN 2 THEN party // 9 ELSE k % 100 END AS entity, {SCOPES}[CAST(idx % 4 AS INT) + 1] AS scope FROM gold) GROUP BY ALL""")
def implied_relationships(v: Views):
    """Relationship of a counterparty to the issuer as the parent table implies it, by the scope of its name."""
    key = F.col("s_suppkey")
    parents = v.table("supplier").select(F.concat(F.lit("S"), key).alias("node"), F.when(key > 0, F.concat(F.lit("S"), F.floor(key / 3))).alias("parent"))
    p, k = F.col("party"), F.col("k")
    entity = F.when(k % 4 == 0, p).when(k % 4 == 1, F.floor(p / 3)).when(k % 4 == 2, F.floor(p / 9)).otherwise(k % 100)
    rows = gold(v).select(F.concat(F.lit("S"), p).alias("issuer"), F.concat(F.lit("S"), entity).alias("entity"), F.element_at(F.array(*map(F.lit, SCOPES)), (F.col("idx") % 4 + 1).cast("int")).alias("scope"))
    some = rows.groupBy("issuer", "entity", "scope").agg(F.count("*").alias("n"))
    return cl.implied_relationship(some, v.stored("up_chain", lambda v: ancestors(parents))).select("issuer", "entity", "scope", "implied", "n")


# ------------------------------------------------------------------ scenarios on annualised revenue
SCENARIOS = [("input up", 0.1, 0.0), ("price down", 0.0, -0.05), ("both", 0.2, -0.1), ("relief", -0.05, 0.05)]
TRACKED = FINISHED[:2]
add_view("ytd", """SELECT f.code, f.period, available_by, CAST(sum(p.revenue) AS BIGINT) AS revenue FROM facts_q f JOIN period_public USING (period) JOIN facts_q p ON p.code = f.code AND p.fy = f.fy AND p.q <= f.q GROUP BY ALL""")


@query("X10 X11 X19", f"""WITH r AS (SELECT code, as_of, period, revenue * CASE substr(period, 5) WHEN '0331' THEN 4.0 WHEN '0630' THEN 2.0 WHEN '0930' THEN CAST(4.0 AS DOUBLE) / 3.0 ELSE 1.0 END::DOUBLE / 1e10 AS yi FROM (
    SELECT y.*, as_of, row_number() OVER (PARTITION BY code, as_of ORDER BY period DESC) AS rk FROM ytd y JOIN dates ON available_by <= as_of) WHERE rk = 1),
  s AS (SELECT as_of, code, sum(share) AS s FROM exposure_asof WHERE product IN {tuple(TRACKED)} GROUP BY ALL), m AS (SELECT * FROM (VALUES {", ".join(f"('{n}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for n, a, b in SCENARIOS)}) x(scenario, input_move, price_move))
  SELECT {DAY}, e.code, period, scenario, round(yi, 6) AS revenue_annual_yi, round(cost, 8) + 0.0::DOUBLE AS cost_yi, round(rev, 6) + 0.0::DOUBLE AS revenue_yi, round(coalesce(rev, 0) - cost, 8) + 0.0::DOUBLE AS profit_yi, CASE WHEN equity > 0 THEN round((coalesce(rev, 0) - cost) * 1e8 / equity, 6) + 0.0::DOUBLE END AS to_equity FROM (
    SELECT e.as_of, e.code, e.equity, r.period, scenario, yi, (e.cost_yi * 10) * input_move AS cost, yi * s * price_move AS rev FROM company_effect e, m LEFT JOIN r ON r.code = e.code AND r.as_of = e.as_of LEFT JOIN s ON s.code = e.code AND s.as_of = e.as_of) e""".replace("FROM company_effect e, m LEFT JOIN", "FROM company_effect e CROSS JOIN m LEFT JOIN"))
def company_scenarios(v: Views):
    """Effect of each scenario of the table on a company: purchased inputs, and annualised revenue of the latest public period."""
    q = v.facts_q.select("code", "period", "fy", "q", "revenue")
    ytd = q.withColumn("revenue", F.sum("revenue").over(W.partitionBy("code", "fy").orderBy("q"))).withColumn("public", available_by(F.col("period")))      # four quarters
    last = latest_as_of(ytd, ["code"], "public", AS_OF, ["period", "revenue"], prefer=["period"])
    factor = lookup(F.substring("period", 5, 4), rules.ANNUALIZE, 1.0)
    last = last.select("code", "as_of", "period", (F.col("revenue") * factor / 1e10).alias("yi"))
    tracked = shares(v).where(F.col("product").isin(*TRACKED)).groupBy("as_of", "code").agg(F.sum("share").alias("s"))
    moves = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(a).alias("i"), F.lit(b).alias("p")) for n, a, b in SCENARIOS])).alias("m")
    t = xp.company_effects(v).select("as_of", "code", "equity", (F.col("cost_yi") * 10).alias("bought"), moves).join(last, ["code", "as_of"], "left").join(tracked, ["as_of", "code"], "left")
    cost, rev = F.col("bought") * F.col("m.i"), F.col("yi") * F.col("s") * F.col("m.p")
    profit = F.coalesce(rev, F.lit(0.0)) - cost
    return t.select(day(), "code", "period", "m.scenario", F.round("yi", 6).alias("revenue_annual_yi"), F.round(cost, 8).alias("cost_yi"), F.round(rev, 6).alias("revenue_yi"),
                    F.round(profit, 8).alias("profit_yi"), F.when(F.col("equity") > 0, F.round(profit * 1e8 / F.col("equity"), 6)).alias("to_equity"))


@query("X29", f"""SELECT CAST(l.as_of AS VARCHAR) AS as_of, round(l.value, 6) AS value, round(l.value - l.base, 6) AS change, CASE WHEN p <= 0.2 THEN 'low' WHEN p >= 0.8 THEN 'high' ELSE '' END AS band FROM (
  SELECT l.as_of, l.value, l.base, round(count(CASE WHEN h.value <= l.value AND h.date >= l.date - INTERVAL 36 MONTH THEN 1 END) / count(CASE WHEN h.date >= l.date - INTERVAL 36 MONTH THEN 1 END), 6) AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY date DESC) AS rk FROM (SELECT date, value, lag(value, 20) OVER (ORDER BY date) AS base FROM margin_s) JOIN dates ON date <= as_of) l JOIN margin_s h ON h.date <= l.as_of WHERE rk = 1 GROUP BY ALL) l""")
def margin_context(v: Views):
    """Level of the margin, its change over 20 days, and whether it is low or high within three years."""
    s = xp.margin_series(v)
    moved = s.withColumn("base", F.lag("value", 20).over(W.partitionBy("kind").orderBy("date")))             # one series, bounded by the calendar
    last = latest_as_of(moved, ["kind"], "date", AS_OF, ["value", "base"])
    at = ex.history_position(s, AS_OF, ["kind"]).select("as_of", F.round("pct_3y", 6).alias("p"))
    band = F.when(F.col("p") <= 0.2, "low").when(F.col("p") >= 0.8, "high").otherwise("")
    return last.join(at, "as_of").select(day(), F.round("value", 6).alias("value"), F.round(F.col("value") - F.col("base"), 6).alias("change"), band.alias("band"))


# ------------------------------------------------------------------ prices of products, checks of companies
add_view("price_stats", """SELECT 'P_' || p_type AS product, CAST(year(l_shipdate) AS INT) AS year, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0::DOUBLE / sum(l_quantity) AS mean_price,
  min(CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0::DOUBLE / l_quantity) AS low, max(CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0::DOUBLE / l_quantity) AS high, sum(l_quantity)::DOUBLE AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")


@query("X20", """SELECT product, year, round(mean_price, 6) AS mean_price, round(low, 6) AS low, round(high, 6) AS high, volume, round(mean_price / lag(mean_price) OVER w - 1, 6) AS price_change,
  round(volume / lag(volume) OVER w - 1, 6) AS volume_change FROM price_stats WINDOW w AS (PARTITION BY product ORDER BY year)""")
def product_price_statistics(v: Views):
    """Yearly price of each product weighed by volume, its range, and the changes of price and volume against the year before."""
    c = F.col
    part = v.table("part").select("p_partkey", F.concat(F.lit("P_"), "p_type").alias("product"))
    money = cents(c("l_extendedprice"))
    t = (v.table("lineitem").select("l_partkey", F.year("l_shipdate").alias("year"), money.alias("m"), "l_quantity").join(part, c("l_partkey") == c("p_partkey")).groupBy("product", "year")
         .agg((F.sum("m") / F.lit(100.0) / F.sum("l_quantity")).alias("mean"), F.min(c("m") / F.lit(100.0) / c("l_quantity")).alias("low"),
              F.max(c("m") / F.lit(100.0) / c("l_quantity")).alias("high"), F.sum("l_quantity").cast("double").alias("volume")))
    w = W.partitionBy("product").orderBy("year")                     # a handful of years
    return t.select("product", "year", F.round("mean", 6).alias("mean_price"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "volume",
                    F.round(c("mean") / F.lag("mean").over(w) - 1, 6).alias("price_change"), F.round(c("volume") / F.lag("volume").over(w) - 1, 6).alias("volume_change"))


#: Companies without a disclosed hedge of goods, for the check of input costs.
_UNHEDGED = "CAST(substr({0}, 2) AS BIGINT) % 3 <> 0"


@query("X30 F17", f"""SELECT CAST(as_of AS VARCHAR) AS as_of, code, i AS pos, checks[i] AS item FROM (SELECT f.as_of, f.code, list_slice(list_filter([
    CASE WHEN red_lines <> '' THEN 'debt_arrangements' END, CASE WHEN events_after_report > 0 THEN 'events_after_report' END, CASE WHEN f.tier = 'weak' AND p.proxy_tier IS NOT NULL THEN 'group_support' END,
    CASE WHEN to_equity <= -0.1 AND {_UNHEDGED.format('f.code')} THEN 'input_cost_hedge' END, CASE WHEN n_in > 0 THEN 'incoming_paths' END, CASE WHEN r.first IS NOT NULL THEN 'report_signal ' || r.first END], lambda x: x IS NOT NULL), 1, 3) AS checks
  FROM fragility f JOIN companies c ON c.code = f.code LEFT JOIN (SELECT as_of, code, round((coalesce(revenue_effect_yi, 0) - cost_yi) * 1e8 / equity, 6) AS to_equity FROM company_effect WHERE equity > 0) e ON e.as_of = f.as_of AND e.code = f.code
  LEFT JOIN g_proxy p ON p.as_of = f.as_of AND p.group_id = c.group_id
  LEFT JOIN (SELECT as_of, code, CASE WHEN np > 0 AND dn < 0 THEN 'loss_before_nonrecurring' WHEN np <> 0 AND abs(np - dn) >= CAST(0.3 AS DOUBLE) * abs(np) THEN 'nonrecurring_share' WHEN np > 0 AND ocf < 0 THEN 'negative_cash_flow'
    WHEN np > 0 AND ocf < CAST(0.5 AS DOUBLE) * np THEN 'low_cash_flow' END AS first FROM report_asof) r ON r.as_of = f.as_of AND r.code = f.code
  LEFT JOIN (SELECT as_of, dst, count(*) AS n_in FROM g_fsteps WHERE score > 0 GROUP BY ALL) n ON n.as_of = f.as_of AND n.dst = f.code), generate_series(1, 3) s(i) WHERE i <= len(checks)""")
def company_checks(v: Views):
    """Up to three checks by the fixed order of rules: debts, later events, group support, unhedged inputs, incoming paths, report signals."""
    c = F.col
    proxy = g.proxies(v).select("as_of", "group_id", "proxy_tier")
    effect = xp.company_effects(v).where("equity > 0").select("as_of", "code", F.round((F.coalesce("revenue_effect_yi", F.lit(0.0)) - c("cost_yi")) * 1e8 / c("equity"), 6).alias("to_equity"))
    incoming = scored_steps(v).groupBy("as_of", c("dst").alias("code")).agg(F.count("*").alias("n_in"))
    signal = hi.reports(v).select("as_of", "code", F.get(st.report_signals(c("np"), c("dn"), c("ocf")), F.lit(0)).alias("signal"))
    t = (snapshot(v).join(v.companies.select("code", "group_id"), "code").join(effect, ["as_of", "code"], "left").join(proxy, ["as_of", "group_id"], "left")
         .join(incoming, ["as_of", "code"], "left").join(signal, ["as_of", "code"], "left"))
    unhedged = F.substring("code", 2, 20).cast("long") % 3 != 0
    checks = F.slice(F.array_compact(F.array(
        F.when(c("red_lines") != "", F.lit("debt_arrangements")), F.when(c("events_after_report") > 0, F.lit("events_after_report")),
        F.when((c("tier") == "weak") & c("proxy_tier").isNotNull(), F.lit("group_support")), F.when((c("to_equity") <= -0.1) & unhedged, F.lit("input_cost_hedge")),
        F.when(c("n_in") > 0, F.lit("incoming_paths")), F.when(c("signal").isNotNull(), F.concat(F.lit("report_signal "), "signal")))), 1, 3)
    return t.select("as_of", "code", F.posexplode(checks).alias("pos", "item")).select(day(), "code", (c("pos") + 1).alias("pos"), "item")
